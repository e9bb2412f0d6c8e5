import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisieve.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, v int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2, "y") for i, v, y in rows], SCHEMA)


def brute(rows, parts, entries, rounds):
    """Codes and errors by comparing with every entry, in plain Python."""
    rows = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows]
    width = len(rows[0][1]) // parts
    first = sorted(rows, key=lambda r: (r[0], r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        near = [[nearest(v[p * width:(p + 1) * width], books[p]) for p in range(parts)] for _, v, _ in rows]
        if turn == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [r[1][p * width:(p + 1) * width] for r, n in zip(rows, near) if n[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n)) for (i, _, _), n in zip(rows, near)]
    sums = {}
    for (_, _, e), (_, _, y) in zip(out, rows):
        sums[y] = sums.get(y, 0) + e
    return sorted((*o, sums[y]) for o, (_, _, y) in zip(out, rows)), books


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 60), st.integers(1, 5), st.sampled_from([2, 300, 1 << 25]), st.integers(0, 1000))
def test_search_equals_all_distances(entries, rows, size, largest, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-largest, largest, (entries, size)), rng.integers(-largest, largest, (rows, size))
    near, distance = vc.EqualAverageSearch(book, largest)(x)
    full = ((x[:, None].astype(object) - book[None]) ** 2).sum(2)
    assert (full.min(1) == distance).all()
    assert [list(r).index(min(r)) for r in full] == near.tolist()


def test_search_leaves_far_sums_out():
    book = np.arange(256)[:, None] * np.full((1, 16), 100)
    x = np.random.default_rng(0).integers(0, 25_600, (2000, 1)) + np.random.default_rng(1).integers(-9, 9, (2000, 16))
    search = vc.EqualAverageSearch(book, 30_000)
    search(x)
    assert search.compared < 2000 * 100


@pytest.mark.parametrize("entries", [4, 256])
def test_codes_equal_brute_force(spark, entries):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-40, 40, 8) / 64).tolist(), int(y) if y else None)
            for i, y in zip(rng.permutation(90), rng.integers(0, 4, 90))]
    rows += [(200, [0.5] * 8, 1)] * 3 + [(201, [-0.5, 0.25] * 4, None)] * 2  # repeated rows
    bad = [(1000, None, 1), (-5, [0.1] * 7 + [None], 1), (-6, [0.1] * 7 + [float("nan")], None), (-7, [float("inf")] * 8, 2),
           (-8, [], 2), (500, [0.1] * 12, 2), (501, [0.1] * 7, 2)]
    coded, books = vc.compress(table(spark, rows + bad), entries=entries)
    assert coded.columns == ["vec_id", "code", "error", "label_error"]
    want, want_books = brute(rows, 4, entries, 4)
    assert sorted(map(tuple, coded.collect())) == want
    assert books.entries.tolist() == want_books
    back = vc.decode(coded, books).withColumn("n", F.size("vector")).collect()
    given = {i: v for i, v, _ in rows}
    for row in back:
        assert row.n == 8
        q = np.floor(1024 * np.array(given[row.vec_id]))
        if row.vec_id < 200:
            assert ((q - 1024 * np.array(row.vector)) ** 2).sum() == row.error


def test_empty_null_ids_and_large_components(spark):
    coded, books = vc.compress(table(spark, []))
    assert coded.count() == 0 and books is None
    coded, _ = vc.compress(table(spark, [(None, [0.5] * 4, None), (1, [0.25] * 4, None)]))
    assert sorted(r.code for r in coded.collect()) == ["00000000", "01010101"]
    with pytest.raises(ValueError):
        vc.compress(table(spark, [(1, [1e30] * 4, 1)]))
