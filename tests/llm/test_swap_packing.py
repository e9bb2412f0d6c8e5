import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexisieve.llm import swap_packing as sp
from lexisieve.llm.spaced_encoding import WORD_BPE, SpacedEncoder

LIBRARY = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
ENCODER = SpacedEncoder()
TEXTS = [
    None, "", " ", "one word", "It's  you'll  'QUOTED' they've\n\n  x1234  5", "Größe ÇA va — naïve\ttab\r\n", "漢字 🙂 ²³ ½ a b",
    "<|endoftext|> inside", "<|ENDOFTEXT|> no token, 'S 'Ll!'s", "İstanbul ΣΑΣ é a b\x1cc\x85d", "same same", "same same",
    "ab cd. " * 3000, "x" * 20_000, "_under_score__ ?!... ",
]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abS' \t\n\r1.,_é×İΣ\x0b\x1c ²<|>!", max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """The least number of bins, by dynamic programming over subsets."""
    n = len(lengths)
    fits = [m for m in range(1, 1 << n) if sum(lengths[i] for i in range(n) if m >> i & 1) <= capacity]

    @lru_cache(None)
    def need(rest):
        if not rest:
            return 0
        low = rest & -rest
        return 1 + min(need(rest & ~m) for m in fits if m & low and m & rest == m)

    return need((1 << n) - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_search_is_between_best_fit_and_the_optimum(lengths):
    sizes = np.array(lengths)
    start = sp.best_fit(sizes, 20)
    search = sp.LocalSearch(sizes, start.copy(), 20)
    before = search.squared_fill()
    bins = search.run()
    assert np.bincount(bins, weights=sizes).max() <= 20
    assert fewest(tuple(lengths), 20) <= len(np.unique(bins)) <= len(np.unique(start))
    assert search.squared_fill() >= before


def test_each_kind_of_exchange_empties_a_bin():
    for lengths, bins in [
        ([6, 2, 2], [0, 1, 2]),  # moves
        ([6, 3, 5, 5, 1], [0, 0, 1, 2, 2]),  # one for one
        ([4, 3, 2, 8, 3], [0, 0, 0, 1, 2]),
        ([2, 3, 4, 6, 5], [0, 0, 0, 1, 2]),
    ]:
        sizes = np.array(lengths)
        search = sp.LocalSearch(sizes, np.array(bins), 10)
        before = search.squared_fill()
        found = search.run()
        assert len(np.unique(found)) == -(-sizes.sum() // 10) and search.squared_fill() > before
    rng = np.random.default_rng(3)
    lengths = rng.integers(500, 1100, 3000)
    start = sp.best_fit(lengths, 2048)
    assert len(np.unique(sp.pack(lengths, 2048))) < 0.985 * len(np.unique(start))


def test_two_for_one_and_one_for_two():
    capacity, kinds = 100, set()
    rng = np.random.default_rng(1)
    search = sp.LocalSearch(lengths := rng.integers(15, 60, 300), sp.best_fit(lengths, capacity), capacity)
    real = search._exchange

    def seen(*given):
        found = real(*given)
        if found:
            kinds.add((len(found[0]), len(found[1])))
        return found

    search._exchange = seen
    search.run()
    assert {(1, 1), (2, 1), (1, 2)} <= kinds


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces_are_whole(spark, parts):
    rows = [(i * 7 % 15, t, "x", i, None, 3) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, length int, key string, ids int").repartition(parts)
    got = sp.pack_documents(docs, with_ids=True).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    for doc_id, text, *_ in rows:
        want = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc_id].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and np.concatenate(own.ids.tolist()).tolist() == want
        for r in own.itertuples():
            assert r.start == 2048 * r.piece and r.length == min(2048, len(want) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 2048)


def test_batches_repeated_rows_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    pieces = sp.pack_documents(docs).collect()
    assert len(pieces) == 4 and len({p.sequence_id for p in pieces}) == 1 and sorted(p.offset for p in pieces) == [0, 3, 6, 9]
    assert sum(p.doc_id is None for p in pieces) == 1
    assert sp.pack_documents(docs.limit(0)).count() == 0
    many = spark.range(5000).selectExpr("id AS key", "id % 700 + 1 AS length")
    placed = sp.place(many, 2048, batch=500).join(many, "key").groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in placed)
    assert max(r[1] for r in placed) <= 2048 and total == sum(k % 700 + 1 for k in range(5000))
    assert len(placed) <= -(-total // 2048) + 10


