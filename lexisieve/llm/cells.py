"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Every vector belongs to the cell of its nearest centre. Two vectors of cosine
``c`` are at most sqrt(2 - 2c) apart, so a vector has to be compared outside
its cell only with cells whose bisecting plane is that near. It also has to lie
within the angle of the link of some member, which is at most the cell's widest
angle from its centre, and at least its narrowest. Both bounds are exact: no
link is lost to the cells, whatever the vectors. Inside a cell, vectors are
compared block by block as matrix products; a block pair emits link counts and
one edge per vector, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.hashing import set_key
from lexisieve.llm.components import connected
from lexisieve.session import materialize

#: Vectors per block; a task of the comparison holds two.
BLOCK = 1024
#: Centres at most: with 64 doubles each, 2 MB in every task.
MOST_CELLS = 4096


def centres(vectors: DataFrame, length: int, total: int, per_cell: int, sample_rows: int, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means, fitted on a hash sample of ``sample_rows`` vectors at most."""
    k = max(1, min(MOST_CELLS, sample_rows // 8, math.ceil(total / per_cell)))
    share = min(1.0, sample_rows / max(total, 1))
    sample = vectors.where((F.size("v") == length) & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(share * 1e6)))
    features = sample.select(array_to_vector("v").alias("features")).cache()
    try:
        if k == 1 or features.count() <= k:
            return np.eye(1, length)
        model = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=8, seed=seed).fit(features)
    finally:
        features.unpersist()
    found = np.array(model.clusterCenters())
    norms = np.linalg.norm(found, axis=1)
    return found[norms > 0] / norms[norms > 0, None]


def _angles(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """Per cell the least and the greatest angle of a member from the centre; an empty cell has none (inf, -inf)."""
    length, n = points.shape[1], len(points)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        for frame in frames:
            values = [v for v in frame["v"] if len(v) == length]
            if not values:
                continue
            x = np.array(values, np.float64)
            near = x / np.linalg.norm(x, axis=1)[:, None] @ points.T
            own = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))
            np.minimum.at(least, own, angle)
            np.maximum.at(most, own, angle)
        found = np.flatnonzero(least < np.inf)
        yield pd.DataFrame({"cell": found, "least": least[found], "most": most[found]})

    rows = vectors.select("v").mapInPandas(measure, "cell long, least double, most double").groupBy("cell").agg(
        F.min("least").alias("least"), F.max("most").alias("most")).collect()  # one row per cell
    out = np.array([np.full(n, np.inf), np.full(n, -np.inf)])
    for row in rows:
        out[:, row.cell] = row.least, row.most
    return out


def _assign(vectors: DataFrame, points: np.ndarray, threshold: float, kind: str) -> DataFrame:
    """Each vector in its own cell (``home``) and as a visitor in the later cells that it may have links to.
    Vectors of another length than the centres' have a cell per length."""
    length = points.shape[1]
    reach, turn = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-9, math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    least, most = _angles(vectors, points)
    gaps = 1.0 / np.maximum(np.sqrt(np.maximum(2 - 2 * points @ points.T, 0)), 1e-9)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, cells, home = [], [], []
            values = frame["v"].to_list()
            fit = np.array([k for k, v in enumerate(values) if len(v) == length], np.int64)
            other = np.array([k for k, v in enumerate(values) if len(v) != length], np.int64)
            if len(fit):
                x = np.array([values[k] for k in fit], np.float64)
                x /= np.linalg.norm(x, axis=1)[:, None]
                near = x @ points.T
                own = near.argmax(axis=1)
                to_plane = (near[np.arange(len(x)), own][:, None] - near) * gaps[own]
                angle = np.arccos(np.clip(near, -1, 1))
                r, c = np.nonzero((to_plane <= reach) & (angle <= most + turn) & (angle >= least - turn)
                                  & (np.arange(len(points)) > own[:, None]))
                rows += [fit, fit[r]]
                cells += [own, c]
                home += [np.ones(len(fit), bool), np.zeros(len(r), bool)]
            rows.append(other)
            cells.append(np.array([-len(values[k]) for k in other], np.int64))
            home.append(np.ones(len(other), bool))
            at = np.concatenate(rows)
            packed = [np.array(v, kind).tobytes() for v in values]
            yield pd.DataFrame({"cell": np.concatenate(cells), "home": np.concatenate(home), "id": frame["id"].to_numpy()[at],
                                "copies": frame["copies"].to_numpy()[at], "v": [packed[k] for k in at]})

    return vectors.mapInPandas(place, "cell long, home boolean, id long, copies long, v binary")


def _compare(group: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """Links between two blocks of a cell: per vector the number of linked vectors and its least relative."""
    left, right = group[group["side"] != 1], group[group["side"] != 0]
    ids = left["id"].to_numpy(), right["id"].to_numpy()
    a, b = (np.frombuffer(b"".join(x["v"]), kind).reshape(len(x), -1).astype(np.float64) if len(x) else np.zeros((0, 1)) for x in (left, right))
    if not len(a) or not len(b):
        return pd.DataFrame({"id": [], "n": [], "root": []})
    cosine = a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    linked = cosine >= threshold
    same = bool((group["side"] == 2).any())
    linked &= ids[0][:, None] != ids[1][None, :]
    counts = [linked @ right["copies"].to_numpy(), linked.T @ left["copies"].to_numpy()]
    roots = [ids[0].copy(), ids[1].copy()]
    far = np.iinfo(np.int64).max
    while True:
        down = np.minimum(roots[1], np.where(linked, roots[0][:, None], far).min(axis=0))
        up = np.minimum(roots[0], np.where(linked, down[None, :], far).min(axis=1))
        if same:
            up = down = np.minimum(up, down)
        if (down == roots[1]).all() and (up == roots[0]).all():
            break
        roots = [up, down]
    sides = (0,) if same else (0, 1)
    out = pd.DataFrame({"id": np.concatenate([ids[s] for s in sides]), "n": np.concatenate([counts[s] for s in sides]),
                        "root": np.concatenate([roots[s] for s in sides])})
    return out[out["n"] > 0]


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 per_cell: int = 4_000, sample_rows: int = 20_000) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` (smallest id reachable) and ``kept``.

    Rows link if their cosine, in double precision, is ``threshold`` or more.
    Vectors that are null, empty or zero, or hold null or non-finite components
    link with nothing; nor do vectors of different lengths. Equal vectors are
    compared once and counted as often as they occur. Rows that repeat an id
    are vectors of their own; other columns are ignored; an empty table gives
    no rows.
    """
    # single precision travels as it is; all products are taken in double precision
    kind = "<f4" if "float" in table.schema[vector_col].dataType.simpleString() else "<f8"
    vector = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))
    keyed = materialize(table.select(F.col(id_col).cast("long").alias("id"), F.when(sound, vector).alias("v")).withColumn(
        "key", set_key(F.col("v"))))
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    vectors = materialize(keyed.join(classes, ["key", "id"]).dropDuplicates(["key"]))
    lengths = vectors.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    if lengths:
        points = centres(vectors, lengths[0]["length"], lengths[0]["count"], per_cell, sample_rows)
    else:
        points = np.eye(1)
    placed = materialize(_assign(vectors.select("id", "v", "copies"), points, threshold, kind))
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("members"), F.count_if(~F.col("home")).alias("visitors"))
    spread = lambda column: F.ceil(F.col(column) / BLOCK).cast("int")
    blocks = placed.join(sizes, "cell").withColumns({"m": spread("members"), "w": spread("visitors")}).where("m > 0")
    block = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("m")).otherwise(F.col("w"))).cast("int")
    blocks = blocks.withColumn("b", block)
    empty = F.array().cast("array<struct<i:int,j:int,side:int>>")
    work = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    members = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: work(
            F.least("b", o), F.greatest("b", o), F.when(o == F.col("b"), 2).when(F.col("b") < o, 0).otherwise(1))),
        F.when(F.col("w") > 0, F.transform(F.sequence(F.lit(1), F.col("w")), lambda o: work(
            F.col("b"), -o, F.lit(0)))).otherwise(empty))
    visitors = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: work(o, -(F.col("b") + 1), F.lit(1)))
    dealt = blocks.select("cell", "id", "copies", "v", F.inline(F.when(F.col("home"), members).otherwise(visitors)))
    found = materialize(dealt.groupBy("cell", "i", "j").applyInPandas(
        lambda group: _compare(group, threshold, kind), "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    component = connected(found, "id", "root")
    whole = classes.join(counts, "id", "left").join(component, "id", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    return keyed.select("id", "key").join(whole, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), (F.col("id") == F.coalesce("component", "id")).alias("kept"))
