"""Approximate nearest neighbours by multi-probe random-projection tables.

A table is a tree of cuts. A cut lies between the two halves of a node's sample,
found from two random points by a few rounds of two means, so that it follows the
points: clusters stay together and dense ones are divided as finely as the rest.
A node that holds more than ``leaf_rows`` points gets a tree of its own, fitted
on a bounded sample of its points, until leaves are small: a level divides by up
to 1,024, and all nodes of a level are fitted at once. Every point is in one leaf
per table. A query visits leaves by the sum of squared distances to the cuts on
whose far side they lie. How many it has to visit (probes) follows from a recall
asked for: a bounded sample of queries is compared with all points. Leaves and
their queries are compared block by block, and a block emits ``k`` rows per query,
so the output does not depend on the size of a leaf. Every point is indexed; only
the cuts and the number of probes come from samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.functions.hashing import seeded, set_key
from lexisieve.operators.index import top_n
from lexisieve.operators.knn import _nearest
from lexisieve.session import materialize, small_side

#: Binary levels of one tree, and sampled points per leaf of it.
MOST_LEVELS, SAMPLED = 10, 32
#: Leaves per table that a query may visit at most, if a recall is asked for.
MOST_PROBES = 1024
#: Trees below trees; node numbers stay in 64 bits.
MOST_DEPTH = 5
_BLOCK_QUERIES = 1024
_PROBE_ROWS = 16_384  # visits, each with its query's vector, in one frame


class Tree:
    """``2**levels - 1`` cuts in heap order: a point goes right where ``x . normal > cut``."""

    def __init__(self, normals: np.ndarray, cuts: np.ndarray):
        self.normals, self.cuts = normals, cuts
        self.levels = int(math.log2(len(cuts) + 1))

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int, seed: int) -> Tree:
        rng = np.random.default_rng(seed)
        normals, cuts = np.zeros((2 ** levels - 1, sample.shape[1])), np.zeros(2 ** levels - 1)
        members = {0: np.arange(len(sample))}
        for node in range(len(cuts)):
            own = members.pop(node, np.array([], np.int64))
            direction = cls._apart(sample[own], rng)
            if not direction.any():
                direction = rng.normal(size=sample.shape[1])
            normals[node] = direction / (np.linalg.norm(direction) or 1.0)
            along = sample[own] @ normals[node]
            cuts[node] = cls._between(along) if len(own) else 0.0
            right = along > cuts[node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        return cls(normals, cuts)

    @staticmethod
    def _apart(x: np.ndarray, rng) -> np.ndarray:
        """From one half of the rows to the other, by two means from two random rows; zeros if there are no halves."""
        if len(x) < 2:
            return np.zeros(x.shape[1])
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            near = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        return a - b

    @staticmethod
    def _between(along: np.ndarray) -> float:
        """The middle of the widest gap between neighbours in the inner four fifths of the values."""
        values = np.sort(along)
        low, high = len(values) // 10, len(values) - len(values) // 10
        if high - low < 3:
            return float(np.median(values))
        gaps = np.diff(values[low:high])
        k = low + int(gaps.argmax())
        middle = float(np.median(values))
        # a gap that stands out parts clusters; without one the halves are even
        return float(values[k] + values[k + 1]) / 2 if gaps.max() > 8 * gaps.mean() else middle

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[node]) > self.cuts[node])
        return node - len(self.cuts)

    def probes(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For every row the ``most`` leaves of least penalty, and the penalties."""
        gaps = x @ self.normals.T - self.cuts
        penalty = np.zeros((len(x), 1))
        for level in range(self.levels):
            gap = gaps[:, 2 ** level - 1:2 ** (level + 1) - 1]
            left = penalty + np.where(gap > 0, gap, 0) ** 2
            right = penalty + np.where(gap > 0, 0, gap) ** 2
            penalty = np.stack([left, right], 2).reshape(len(x), -1)
        most = min(most, penalty.shape[1])
        best = np.argsort(penalty, axis=1, kind="stable")[:, :most]
        return best, np.take_along_axis(penalty, best, 1)

    def packed(self) -> tuple[bytes, bytes]:
        return self.normals.tobytes(), self.cuts.tobytes()

    @classmethod
    def unpacked(cls, normals: bytes, cuts: bytes) -> Tree:
        c = np.frombuffer(cuts)
        return cls(np.frombuffer(normals).reshape(len(c), -1), c)


def _levels(count: Column | int, leaf_rows: int):
    if isinstance(count, int):
        return min(MOST_LEVELS, max(1, math.ceil(math.log2(count / leaf_rows))))
    return F.least(F.lit(MOST_LEVELS), F.greatest(F.lit(1), F.ceil(F.log2(count / leaf_rows)))).cast("int")


def _draw(seed: int, *cols) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _fit_nodes(points: DataFrame, heavy: DataFrame, leaf_rows: int, seed: int) -> DataFrame:
    """``table, node, normals, cuts`` of each heavy node, fitted on a sample of bounded size."""
    levels = _levels(F.col("count"), leaf_rows)
    drawn = points.join(heavy, ["table", "node"]).withColumn("levels", levels).where(
        _draw(seed, "key", "table", "node") < SAMPLED * F.pow(F.lit(2.0), F.col("levels")) / F.col("count"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        table, node = int(group["table"].iloc[0]), int(group["node"].iloc[0])
        sample = np.stack(group.sort_values("key")["vec"].to_numpy())
        normals, cuts = Tree.fit(sample, int(group["levels"].iloc[0]), [seed, table, node % (1 << 31)]).packed()
        return pd.DataFrame({"table": [table], "node": [node], "normals": [normals], "cuts": [cuts]})

    return materialize(drawn.select("table", "node", "levels", "key", "vec").groupBy("table", "node").applyInPandas(
        fit, "table int, node long, normals binary, cuts binary"))


def _blocks(rows: DataFrame, name: str, counts: DataFrame, size: int, *more: str) -> DataFrame:
    """One row per node and block of some ``size`` rows: their ``name`` column, vectors and ``more``, as arrays.
    A node with many rows has many blocks."""
    salted = rows.join(counts, ["table", "node"]).withColumn(
        "salt", F.pmod(F.xxhash64(name, "table"), F.ceil(F.col("count") / size)))
    return salted.groupBy("table", "node", "salt").agg(
        F.collect_list(F.struct(name, "vec", *more)).alias("rows")).select(
        "table", "node", F.col(f"rows.{name}").alias(f"{name}s"), F.flatten("rows.vec").alias("vecs"),
        *[F.col(f"rows.{c}").alias(f"{c}s") for c in more])


def _matrix(flat, rows: int) -> np.ndarray:
    return np.asarray(flat, np.float64).reshape(rows, -1)


def _visits_of(tree: Tree, x: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x``, leaves and penalties of at most ``_PROBE_ROWS`` visits at a time (one query's, if that are more)."""
    step = max(1, _PROBE_ROWS // min(most, len(tree.cuts) + 1))
    for at in range(0, len(x), step):
        leaves, penalty = tree.probes(x[at:at + step], most)
        yield np.repeat(np.arange(at, at + len(leaves)), leaves.shape[1]), leaves.ravel(), penalty.ravel()


def _refine_points(points: DataFrame, heavy: DataFrame, trees: DataFrame, size: int) -> DataFrame:
    """Points of heavy nodes in the leaves of their trees; others stay."""
    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                x = _matrix(r.vecs, len(r.keys))
                leaves = Tree.unpacked(r.normals, r.cuts).leaves(x)
                yield pd.DataFrame({"key": r.keys, "ids": list(r.idss), "vec": list(x), "table": np.int32(r.table),
                                    "node": (r.node << MOST_LEVELS) + leaves + 1})

    moved = _blocks(points, "key", heavy, size, "ids").join(trees, ["table", "node"]).mapInPandas(down, points.schema)
    return moved.unionByName(points.join(heavy, ["table", "node"], "left_anti"))


def _refine_probes(probes: DataFrame, heavy: DataFrame, trees: DataFrame, most: int, size: int) -> DataFrame:
    """Probes of heavy nodes go on into the leaves of their trees; the best ``most`` of a query and table stay."""
    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                x = _matrix(r.vecs, len(r.ids))
                ids, before = np.asarray(r.ids), np.asarray(r.penaltys)
                for rows, leaves, penalty in _visits_of(Tree.unpacked(r.normals, r.cuts), x, most):
                    yield pd.DataFrame({
                        "id": ids[rows], "vec": [x[i] for i in rows], "table": np.int32(r.table),
                        "node": (r.node << MOST_LEVELS) + leaves + 1, "penalty": penalty + before[rows]})

    asked = small_side(probes.join(heavy, ["table", "node"], "left_semi").groupBy("table", "node").count())
    moved = _blocks(probes, "id", asked, size, "penalty").join(trees, ["table", "node"]).mapInPandas(down, probes.schema)
    every = moved.unionByName(probes.join(heavy, ["table", "node"], "left_anti"))
    best = Window.partitionBy("id", "table").orderBy("penalty", "node")
    return every.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).drop("r")


class ProjectionIndex:
    """Tables of projections over the distinct vectors of ``points`` (``key, vec, ids``)."""

    def __init__(self, points: DataFrame, tables: int = 2, leaf_rows: int = 1024, seed: int = 5):
        self.points, self.seed, self.leaf_rows = points, seed, leaf_rows
        n = points.count()
        levels = _levels(n, leaf_rows)
        share = SAMPLED * 2 ** levels / n
        rows = points.where(_draw(seed, "key") < share).orderBy("key").select("vec").collect()  # some 33,000 at most
        sample = np.array([r.vec for r in rows] or [points.first().vec])
        self.roots = roots = [Tree.fit(sample, levels, [seed, t]) for t in range(tables)]

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["vec"].to_numpy())
                    for t, tree in enumerate(roots):
                        yield frame.assign(table=np.int32(t), node=tree.leaves(x) + 1)

        placed = materialize(points.mapInPandas(
            place, "key string, vec array<double>, ids array<long>, table int, node long"))
        self.below: list[tuple[DataFrame, DataFrame]] = []
        for depth in range(1, MOST_DEPTH):
            heavy = materialize(placed.groupBy("table", "node").count().where(F.col("count") > 2 * leaf_rows))
            if heavy.isEmpty():
                break
            trees = _fit_nodes(placed, heavy, leaf_rows, seed + depth)
            self.below.append((heavy, trees))
            placed = materialize(_refine_points(placed, heavy, trees, 2 * leaf_rows))
        self.placed = placed

    def visits(self, queries: DataFrame, most: int) -> DataFrame:
        """``id, vec, table, node, penalty``: the ``most`` leaves of each table that a query (``id, vec``) visits."""
        roots = self.roots

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["vec"].to_numpy())
                    for t, tree in enumerate(roots):
                        for rows, leaves, penalty in _visits_of(tree, x, most):
                            yield frame.iloc[rows].assign(table=np.int32(t), node=leaves + 1, penalty=penalty)

        asked = materialize(queries.select("id", "vec").mapInPandas(
            ask, "id long, vec array<double>, table int, node long, penalty double"))
        for heavy, trees in self.below:
            asked = materialize(_refine_probes(asked, heavy, trees, most, _BLOCK_QUERIES))
        return asked

    def probes_for(self, queries: DataFrame, k: int, recall: float, sample_rows: int = 200) -> int:
        """The least number of probes with which a sample of the queries finds that share of its true neighbours."""
        few = materialize(top_n(queries.select("id", "vec"), [seeded(self.seed, F.col("id")), "id"], sample_rows))
        rows = few.orderBy("id").collect()
        if not rows:
            return 1
        asking, a = np.array([r.id for r in rows]), np.array([r.vec for r in rows])

        def closest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None  # the k nearest of this task for every query
            for frame in frames:
                if len(frame):
                    b = np.stack(frame["vec"].to_numpy())
                    for at, cols, d in _nearest(a, np.arange(len(b)), b, k, 1.0):
                        new = pd.DataFrame({"id": asking[at], "key": frame["key"].to_numpy()[cols], "distance": d})
                        best = new if best is None else pd.concat([best, new])
                    best = best.sort_values(["distance", "key"]).groupby("id").head(k)
            if best is not None:
                yield best

        by_id = Window.partitionBy("id").orderBy("distance", "key")
        true = self.points.select("key", "vec").mapInPandas(closest, "id long, key string, distance double").withColumn(
            "r", F.row_number().over(by_id)).where(F.col("r") <= k).select("id", "key")
        order = Window.partitionBy("id", "table").orderBy("penalty", "node")
        ranked = self.visits(few, MOST_PROBES).select("id", "table", "node", F.row_number().over(order).alias("probe"))
        needed = true.join(self.placed.select("key", "table", "node"), "key").join(
            ranked, ["id", "table", "node"], "left").groupBy("id", "key").agg(F.min("probe").alias("probe"))
        numbers = np.sort([r.probe if r.probe is not None else np.inf for r in needed.select("probe").collect()])
        reached = numbers[min(len(numbers) - 1, math.ceil(recall * len(numbers)) - 1)]
        return MOST_PROBES if np.isinf(reached) else int(reached)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """``id, neighbor, distance``: the ``k`` nearest of every visited block; a neighbour is listed once."""
        asked = self.visits(queries, probes)

        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    sizes = np.array([len(i) for i in r.p_ids])
                    ids = np.concatenate(r.p_ids).astype(np.int64)
                    b = np.repeat(_matrix(r.p_vecs, len(sizes)), sizes, axis=0)
                    asking = np.asarray(r.q_ids)
                    for rows, cols, d in _nearest(_matrix(r.q_vecs, len(asking)), ids, b, k, 1.0):
                        yield pd.DataFrame({"id": asking[rows], "neighbor": ids[cols], "distance": d})

        nodes = small_side(self.placed.groupBy("table", "node").count())
        visits = small_side(asked.groupBy("table", "node").count())
        points = _blocks(self.placed, "key", nodes, 2 * self.leaf_rows, "ids").select(
            "table", "node", F.col("idss").alias("p_ids"), F.col("vecs").alias("p_vecs"))
        blocks = _blocks(asked, "id", visits, _BLOCK_QUERIES).select(
            "table", "node", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
        found = blocks.join(points, ["table", "node"]).mapInPandas(compare, "id long, neighbor long, distance double")
        return found.groupBy("id", "neighbor").agg(F.min("distance").alias("distance"))


def knn_lsh(queries: DataFrame, points: DataFrame, id_col: str, vec_col: str, k: int, exclude_self: bool = False,
            recall: float = 0.95, probes: int | None = None, tables: int = 2, leaf_rows: int = 1024,
            seed: int = 5) -> DataFrame:
    """``id, neighbor, rank, distance``: about the ``k`` nearest points of every query by Euclidean distance, ties by
    lowest id. Ids are numbers, unique among the queries; vectors have one length.

    ``recall`` is the share of true neighbours that a sample of 200 queries has to find (all points are compared with
    these); ``probes`` names the number of leaves per table instead. A query is compared with some ``tables * probes *
    leaf_rows`` points. Where all directions are alike, as in random vectors of many dimensions, the number of probes
    grows with the number of leaves. Copies of one vector are compared once. Rows whose vector is null or holds a null
    take no part; an empty side gives no rows.
    """
    want = k + 1 if exclude_self else k

    def whole(df: DataFrame) -> DataFrame:
        vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return vectors.where(F.forall("vec", lambda x: x.isNotNull()))

    lowest = Window.partitionBy("key").orderBy("id")
    unique = materialize(
        whole(points).withColumn("key", set_key(F.col("vec"))).withColumn("r", F.row_number().over(lowest))
        .where(F.col("r") <= want).groupBy("key").agg(
            F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")).select("key", "vec", "ids"))
    asked = materialize(whole(queries))
    if unique.isEmpty() or asked.isEmpty():
        return queries.sparkSession.createDataFrame([], "id long, neighbor long, rank int, distance double")
    tree = ProjectionIndex(unique, tables, leaf_rows, seed)
    found = tree.search(asked, want, probes or tree.probes_for(asked, want, recall))
    if exclude_self:
        found = found.where(F.col("id") != F.col("neighbor"))
    by_id = Window.partitionBy("id").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select(
        "id", "neighbor", "rank", "distance")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_queries, n_neighbors, recall``: the share of exact neighbours that were found. Queries with no neighbour
    found count."""
    hit = exact.select("id", "neighbor").join(
        found.select("id", "neighbor", F.lit(1).alias("hit")), ["id", "neighbor"], "left")
    return hit.agg(F.count_distinct("id").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbors"),
                   F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
