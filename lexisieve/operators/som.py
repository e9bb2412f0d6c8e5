"""Self-organising maps by batch training.

A map is a square grid of nodes, each with a codebook vector. In a round every
vector finds its nearest node, the sums and counts per node are added up in one
aggregation, and a node's new vector is the mean of all vectors, weighted by how
near their nodes are on the grid. The neighbourhood shrinks from round to round.
Vectors stay where they are; only the codebook moves between driver and tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.hashing import seeded
from lexisieve.operators.index import top_n
from lexisieve.session import materialize

#: Longest side of a map: 16,384 codebook vectors at most, whatever the number of rows.
MOST_SIDE = 128

_CELLS = 2_000_000  # numbers in one distance block


@dataclass
class SelfOrganisingMap:
    """``codebook[row * side + column]``; ``errors`` has ``(round, sigma, mean distance to the nearest node)``."""

    codebook: np.ndarray
    side: int
    errors: list[tuple[int, float, float]] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        """``cell, row, column, weights``."""
        rows = [(i, i // self.side, i % self.side, v) for i, v in enumerate(self.codebook.tolist())]
        return spark.createDataFrame(rows, "cell int, row int, column int, weights array<double>")

    @classmethod
    def from_table(cls, stored: DataFrame) -> SelfOrganisingMap:
        rows = stored.orderBy("cell").collect()
        return cls(np.array([r.weights for r in rows]), math.isqrt(len(rows)))


def _nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and squared distance; ties go to the lower node. Blocks of rows are compared, however long a frame is."""
    norms, node = (codebook * codebook).sum(1), np.zeros(len(x), np.int64)
    step = max(1, _CELLS // len(codebook))
    for at in range(0, len(x), step):
        node[at:at + step] = (norms - 2 * x[at:at + step] @ codebook.T).argmin(1)
    return node, ((x - codebook[node]) ** 2).sum(1)


def _vectors(df: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(finite & (F.size(v) > 0), F.lit(False))).select("*", v.alias("__v"))


def _picked(hashed: DataFrame, count: int) -> np.ndarray:
    """The first ``count`` vectors ``__v`` in the order of ``h``, a hash of their text. Only hashes are put in order; rows of
    one hash are copies."""
    hashes = [r.h for r in top_n(hashed.select("h"), ["h"], count).collect()]  # a codebook's worth
    copied = hashed.where(F.col("h") <= max(hashes)).groupBy("h").agg(F.first("__v").alias("v"), F.count(F.lit(1)).alias("n"))
    rows = sorted(copied.collect(), key=lambda r: r.h)  # no more than there are hashes
    return np.repeat(np.array([r.v for r in rows]), [min(r.n, count) for r in rows], axis=0)[:count]


def _smooth(sums: np.ndarray, side: int, sigma: float) -> np.ndarray:
    """Sums per node weighted by a Gaussian of their distance on the grid, one direction after the other."""
    place = np.arange(side)
    weights = np.exp(-((place[:, None] - place) ** 2) / (2 * sigma * sigma))
    grid = sums.reshape(side, side, -1)
    return np.einsum("ca,rax->rcx", weights, np.einsum("rb,bax->rax", weights, grid)).reshape(sums.shape)


def grid_side(n: int) -> int:
    """Side of the map for ``n`` rows: sqrt(5 sqrt(n)), up to ``MOST_SIDE``."""
    return min(MOST_SIDE, math.ceil(math.sqrt(5 * math.sqrt(n))))


def train_map(df: DataFrame, vec_col: str, side: int | None = None, rounds: int = 10, seed: int = 0,
              last_sigma: float = 0.5) -> SelfOrganisingMap:
    """A map of the vectors. Null and empty vectors and vectors with nulls, NaN or infinite components take no part;
    all others have one length.

    The codebook starts as that of vectors picked by hash; sigma falls by equal factors from half the side to
    ``last_sigma``.
    """
    text = F.to_json("__v")
    stored = materialize(_vectors(df, vec_col).select(F.col(vec_col).alias("raw"), seeded(seed, text).alias("h")))
    hashed = stored.select("h", F.col("raw").cast("array<double>").alias("__v"))
    # a task's sums may be as large as its vectors, so that more tasks than keep the cores busy would shuffle too much
    vectors = hashed.select("__v").coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    n = stored.count()
    if not n:
        raise ValueError("no vectors to train a map on")
    side = side or grid_side(n)
    start = _picked(hashed, side * side)
    som = SelfOrganisingMap(start[np.arange(side * side) % len(start)], side)
    length = start.shape[1]
    first = max(side / 2, last_sigma)
    for turn in range(rounds):
        sigma = first * (last_sigma / first) ** (turn / max(1, rounds - 1))

        def sums(frames: Iterator[pd.DataFrame], codebook: np.ndarray = som.codebook) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(codebook), length))
            count, error = np.zeros(len(codebook), np.int64), np.zeros(len(codebook))
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["__v"].to_numpy())
                    node, squared = _nearest(x, codebook)
                    np.add.at(total, node, x)
                    count += np.bincount(node, minlength=len(codebook))
                    error += np.bincount(node, weights=np.sqrt(squared), minlength=len(codebook))
            used = np.flatnonzero(count)
            if len(used):  # a task may have no rows
                yield pd.DataFrame({"node": used, "n": count[used], "error": error[used], "sums": list(total[used])})

        found = vectors.mapInPandas(sums, "node long, n long, error double, sums array<double>")
        added = found.groupBy("node").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), *[
            F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(length)]).collect()  # a row per node
        table = np.zeros((side * side, length + 1))
        for r in added:
            table[r.node] = [*(r[f"s{j}"] for j in range(length)), r.n]
        som.errors.append((turn, sigma, sum(r.error for r in added) / n))
        spread = _smooth(table, side, sigma)
        seen = spread[:, -1] > 1e-12
        som.codebook = np.where(seen[:, None], spread[:, :-1] / np.maximum(spread[:, -1:], 1e-300), som.codebook)
    return som


def assign_nodes(df: DataFrame, som: SelfOrganisingMap, vec_col: str, out: str = "cell") -> DataFrame:
    """``df`` with the nearest node of each vector; null where there is none."""
    codebook = som.codebook

    @F.pandas_udf("int")
    def node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in batches:
            whole = col.map(lambda v: v is not None and len(v) > 0 and np.isfinite(np.asarray(v, np.float64)).all()).to_numpy(bool)
            result = pd.Series([None] * len(col), dtype="Int32")
            if whole.any():
                result[whole] = _nearest(np.stack(col[whole].to_numpy()).astype(np.float64), codebook)[0]
            yield result

    return df.withColumn(out, node(F.col(vec_col).cast("array<double>")))
