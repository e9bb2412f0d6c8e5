"""Compression of vectors to part codes, with equal-average nearest-entry search.

A vector is cut into equal consecutive parts, and each part is replaced by the
number of the nearest entry of its part's codebook. Entries are kept in the
order of their component sums. By Cauchy-Schwarz the squared gap of two sums,
divided by the number of components, is no more than their squared distance, so
the search starts at the part's own sum and goes outward until that bound is
strictly above the best distance on both sides. Parts of similar sums go
outward together, a block of entries at a time, as matrix products of whole
numbers. Vectors stay where they are: a round sends one row of sums and counts
per task and entry, and the codebooks (a few hundred entries) go to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.session import materialize, small_side

#: Parts that go outward together, and entries looked at in the first step; steps double.
TOGETHER, STEP = 256, 16


class EqualAverageSearch:
    """Nearest entries of one codebook (whole numbers, one row per entry) in squared Euclidean distance, ties to the
    lower index. ``compared`` counts the distances computed."""

    def __init__(self, entries: np.ndarray, largest: int):
        n, self.size = entries.shape
        bound = 4 * self.size * largest * largest * n
        if bound >= 1 << 62:
            raise ValueError(f"components up to {largest} are too large for exact distances: scale the vectors")
        self.kind = np.float64 if bound < 1 << 53 else np.int64  # both exact; floats multiply faster
        order = np.lexsort((np.arange(n), entries.sum(1)))
        self.index, self.n = order.astype(self.kind), n
        self.entries = entries[order].astype(self.kind)
        self.sums = entries.sum(1)[order]
        self.squares = (self.entries * self.entries).sum(1)
        self.compared = 0

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every row of ``parts``."""
        sums = parts.sum(1)
        order = np.argsort(sums, kind="stable")
        best = np.empty(len(parts), self.kind)
        for at in range(0, len(parts), TOGETHER):
            rows = order[at:at + TOGETHER]
            best[rows] = self._outward(parts[rows].astype(self.kind), sums[rows])
        whole = best.astype(np.int64)
        return whole % self.n, whole // self.n

    def _outward(self, parts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """distance * entries + index of the nearest entry; ``sums`` ascend."""
        squares = (parts * parts).sum(1)
        low = int(np.searchsorted(self.sums, sums[0]))
        high = int(np.searchsorted(self.sums, sums[-1], side="right"))
        best, step = None, STEP
        begin, end = max(0, low - STEP // 2), min(self.n, high + STEP // 2)
        spans, low, high = [(begin, end)], begin, end
        while spans:
            for a, b in spans:
                found = squares[:, None] - 2 * (parts @ self.entries[a:b].T) + self.squares[a:b]
                found = (found * self.n + self.index[a:b]).min(1) if b > a else np.full(len(parts), np.inf)
                best = found if best is None else np.minimum(best, found)
                self.compared += len(parts) * (b - a)
            spans, step = [], 2 * step
            reach = self.size * (best // self.n)
            # a side is done once its next sum is too far from every part's own
            if low > 0 and ((sums - self.sums[low - 1]) ** 2 <= reach).any():
                spans.append((max(0, low - step), low))
                low = spans[-1][0]
            if high < self.n and ((self.sums[high] - sums) ** 2 <= reach).any():
                spans.append((high, min(self.n, high + step)))
                high = spans[-1][1]
        return best


@dataclass
class Codebooks:
    """``entries[part, index, position]`` as whole numbers; ``largest`` bounds the components' absolute values."""

    entries: np.ndarray
    scale: int
    largest: int

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def searches(self) -> list[EqualAverageSearch]:
        return [EqualAverageSearch(book, self.largest) for book in self.entries]


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> DataFrame:
    """``id, v, label`` of the vectors that can be coded: not null, without null or non-finite components, and as long
    as the vector of the smallest id, whose length has to be a positive multiple of ``parts``."""
    v = F.col(vec_col).cast("array<double>")
    given = df.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label"))
    finite = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                         & (F.size("v") > 0) & (F.size("v") % parts == 0))
    first = finite.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    return finite.where(F.size("v") == (first[0] if first else 0))


def _numbers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    return np.floor(scale * np.asarray(column.flatten(), np.float64).reshape(-1, length)).astype(np.int64)


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of :func:`whole_vectors`: they start as the parts of the ``entries`` smallest ids, and every round
    replaces an entry by the floor of the mean of the parts nearest to it; an entry without parts stays. None for no
    vectors. Fewer vectors than ``entries`` give fewer entries; rows that repeat an id count each."""
    start = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not start:
        return None
    length = len(start[0].v)
    top = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if top * scale >= 1 << 31:
        raise ValueError(f"components up to {top} are too large for exact distances: scale the vectors")
    first = np.floor(scale * np.array([r.v for r in start])).astype(np.int64)
    books = Codebooks(np.stack(_cut(first, parts)), scale, int(top * scale) + 1)
    width, number = length // parts, len(start)
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            searches = books.searches()
            total = np.zeros((parts, number, width), np.int64)
            count = np.zeros((parts, number), np.int64)
            for batch in batches:
                for p, (search, x) in enumerate(zip(searches, _cut(_numbers(batch.column("v"), length, scale), parts))):
                    near, _ = search(x)
                    order = np.argsort(near, kind="stable")
                    used, at = np.unique(near[order], return_index=True)
                    total[p, used] += np.add.reduceat(x[order], at)
                    count[p] += np.bincount(near, minlength=number)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                 pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        found = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
        means = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[
            F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
        fresh = books.entries.copy()
        for row in means.collect():  # a row per entry of the codebooks
            fresh[row.part, row.entry] = [row[f"s{j}"] // row.n for j in range(width)]
        books = Codebooks(fresh, scale, books.largest)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``id, label, code, error``: entry numbers in part order, two hex digits each (four where a codebook has more
    than 256 entries), and the squared distances summed over the parts."""
    parts, number, width = books.entries.shape
    digits = 2 if number <= 256 else 4
    kind = dict(vectors.dtypes)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = books.searches()
        for batch in batches:
            found = [search(x) for search, x in
                     zip(searches, _cut(_numbers(batch.column("v"), parts * width, books.scale), parts))]
            index = np.stack([near for near, _ in found], 1).astype(">u1" if digits == 2 else ">u2")
            text = index.tobytes().hex()
            size = digits * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.array([text[i:i + size] for i in range(0, len(text), size)], pa.string()),
                 pa.array(sum(d for _, d in found), pa.int64())], ["id", "label", "code", "error"])

    return vectors.mapInArrow(codes, f"id {kind['id']}, label {kind['label']}, code string, error long")


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code", out: str = "vector") -> DataFrame:
    """The vectors that the codes stand for, as arrays of doubles; null for a null code."""
    parts, number, width = books.entries.shape
    digits = 2 if number <= 256 else 4

    @F.pandas_udf("array<double>")
    def vector(codes):
        def one(code: str | None):
            if code is None:
                return None
            index = [int(code[digits * p:digits * (p + 1)], 16) for p in range(parts)]
            return np.concatenate([books.entries[p, i] for p, i in enumerate(index)]) / books.scale
        return codes.map(one)

    return coded.withColumn(out, vector(F.col(code_col)))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4,
             entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks | None]:
    """``<id>, code, error, label_error`` of every vector that can be coded (:func:`whole_vectors`), and the codebooks.

    ``label_error`` is the error summed over equal labels, nulls together. Labels are summed before they are joined
    back, so a label held by most rows costs nothing. An empty table gives no rows and no codebooks. Components
    beyond some hundred thousand raise an error, as squared distances would not fit a long. Other columns are ignored.
    """
    vectors = materialize(whole_vectors(df, id_col, vec_col, label_col, parts))
    books = train(vectors, parts, entries, rounds, scale)
    if books is None:
        coded = vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = materialize(encode(vectors, books))
    sums = small_side(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error"), books
