import numpy as np
import pytest

from lexisieve.llm import dropout


@pytest.fixture(scope="module")
def model():
    return dropout.MergeDropout(dropout.PIECE_BPE, 17, 0.1)


def test_every_occurrence_has_its_own_draws(model):
    word, n = " interesting", 3000
    bases = model.bases(5, n)
    cuts = model._cut([word] * n, bases)
    assert cuts == [model.part(word, b) for b in bases.tolist()] == [model.long_part(word, b) for b in bases.tolist()]
    assert len(set(cuts)) > 2 * dropout.VARIANTS
    merges = np.frombuffer(model._root(word).merges, "<u8")
    drawn = model._skips_each(bases[:, None], merges[None, :])
    assert np.abs(drawn.mean(axis=0) - 0.1).max() < 0.03
    assert np.abs(np.corrcoef(drawn.T) - np.eye(len(merges))).max() < 0.1


def test_a_part_of_one_merge_is_split_at_a_tenth_of_its_places(model):
    word = next(p.replace("▁", " ") for p in model.ids if len(p) == 2 and p[0] == "▁" and p[1].isalpha())
    assert len(model._root(word).merges) == 8
    text = (word * 20_000)[1:]
    ids = np.frombuffer(model.encode(text, 3), "<u2")
    assert abs((len(ids) - 20_000) / 20_000 - 0.1) < 0.01
    assert model.decode(ids) == text


def test_paths_forgotten_change_nothing(model, monkeypatch):
    text = "the same interesting words with unusual spellings and " * 300 + "x" * 200 + " tail"
    ids = model.encode(text, 9)
    monkeypatch.setattr(dropout, "PATHS_KEPT", 3)
    monkeypatch.setattr(dropout, "TOGETHER", 50)
    assert dropout.MergeDropout(dropout.PIECE_BPE, 17, 0.1).encode(text, 9) == ids
    assert model.decode(np.frombuffer(ids, "<u2")) == text


def test_agendas_run_side_by_side(model, monkeypatch):
    """New words and words with skips need no agenda of their own; the ids are those of one agenda per part."""
    parts = [f" {'wörter'[:k % 5]}{k * 7919:x}ing" for k in range(500)] + [" 汉字𝄞", "\n\n", "   ", " a▁b", " " + "y" * 70] * 3
    bases = model.bases(11, len(parts))
    alone = [model.part(p, b) for p, b in zip(parts, bases.tolist())]
    calls = []
    monkeypatch.setattr(dropout.MergeDropout, "_short", lambda *given: pytest.fail("an agenda of its own"))
    monkeypatch.setattr(dropout.MergeDropout, "part", lambda self, part, base: calls.append(part) or self.long_part(part, base))
    assert model._cut(parts, bases) == alone
    assert len(calls) == 6
    texts = ["".join(parts)[1:], None, "", "x"] * 3
    assert list(model.encode_each(texts, list(range(12)))) == [model.encode(t, k) for k, t in enumerate(texts)]
