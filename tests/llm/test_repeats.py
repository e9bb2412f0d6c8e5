import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisieve.llm import repeats


def brute_runs(words, least, times):
    """All maximal stretches of each period, smallest period first; a stretch that has a smaller period is left out."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, length, p) for (s, length), p in found.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 24, 3)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@st.composite
def periodic(draw):
    """Sequences with nested, overlapping and broken repetitions."""
    out = []
    for _ in range(draw(st.integers(0, 5))):
        base = draw(st.lists(st.integers(0, 3), min_size=1, max_size=9))
        if draw(st.booleans()):
            base = base * draw(st.integers(1, 4)) + draw(st.lists(st.integers(0, 1), max_size=2))
        out += (base * draw(st.integers(1, 12)))[:draw(st.integers(1, 90))]
    return out


@settings(max_examples=250, deadline=None)
@given(st.lists(periodic(), min_size=1, max_size=5), st.sampled_from([(24, 3), (4, 2), (1, 3), (9, 4)]))
def test_runs_equal_brute_force(documents, limits):
    found = repeats.runs_of_documents(documents, *limits)
    for words, runs in zip(documents, found):
        assert list(map(tuple, runs.tolist())) == brute_runs(words, *limits)


@settings(max_examples=100, deadline=None)
@given(periodic(), st.integers(1, 9))
def test_grammar_agrees_with_the_sequence(words, seed):
    sequence = np.array([10, *words, 11])
    grammar = repeats.Grammar(sequence, seed)
    n = len(sequence)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    keep = a < b
    a, b = a[keep], b[keep]

    def plain(i, j, step):
        k = 0
        while 0 <= i < n and 0 <= j < n and sequence[i] == sequence[j]:
            i, j, k = i + step, j + step, k + 1
        return k

    assert grammar.agree(a, b).tolist() == [plain(i, j, 1) for i, j in zip(a, b)]
    assert grammar.agree(a, b, forward=False).tolist() == [plain(i, j, -1) for i, j in zip(a, b)]


def test_grammar_is_small_on_repetitions_and_levels_are_few():
    grammar = repeats.Grammar(np.array([5, *[1, 2, 3] * 30_000, 6]))
    assert grammar.levels < 40 and len(grammar.sym) < 4 * 90_000
    assert len(np.unique(grammar.sym)) < 100
    grammar = repeats.Grammar(np.concatenate([[7000], np.random.default_rng(0).zipf(1.3, 50_000) % 6000, [7001]]))
    assert grammar.levels < 80 and len(grammar.sym) < 7 * 50_000


def test_long_period_in_a_long_document():
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 500, 9000)]
    words = [int(x) for x in rng.integers(0, 500, 777)] + (base * 4)[:29_000] + [501]
    assert list(map(tuple, repeats.runs_of_documents([words, [1] * 50])[0].tolist())) == brute_runs_of_period(words, 9000)


def brute_runs_of_period(words, p):
    same = [words[i] == words[i + p] for i in range(len(words) - p)]
    first = same.index(True, 700)
    last = len(same) - 1 - same[::-1].index(True)
    return [(first, last + p + 1 - first, p)] if all(same[first:last + 1]) else []


@pytest.mark.parametrize("parts", [1, 3])
def test_digests_equal_brute_force(spark, parts):
    rng = np.random.default_rng(0)
    texts = [None, "", " \t\n", "one", "a b " * 40, ("x y z " * 30) + "x y q " + ("z " * 50), "a\x1cb a\xa0b c\x85d e " * 20,
             "é 漢字 🙂 " * 15, " ".join(map(str, rng.integers(0, 9, 400))), ("u v w " * 9 + "k ") * 7]
    texts += [" ".join(map(str, rng.integers(0, 40, int(n)))) for n in rng.integers(1, 300, 150)]
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(5, texts[5], 1, "x", 2)]  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string, start int").repartition(parts)
    found = repeats.find_runs(docs, prepare=repeats.with_planted_run)
    assert found.columns == ["doc_id", "runs", "collapsed"]
    got = sorted(map(tuple, repeats.digests(found).collect()))
    want = sorted(brute(i, t) for i, t, *_ in rows)
    assert got == want and sum(r[1] > 0 for r in want) > 10 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (1 << 60, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.find_runs(docs).collect()}
    assert [tuple(r) for r in rows[None].runs] == [(0, 30, 1)] and rows[None].collapsed == "a"
    assert rows[1 << 60].runs == [] and rows[1 << 60].collapsed == ""
    assert repeats.digests(repeats.find_runs(docs.limit(0))).count() == 0
