"""Two-dimensional maps from a neighbour graph, by orthogonal power iteration as joins.

Rows and their nearest neighbours form an undirected graph. The coordinates are
the second and third leading eigenvectors of the random walk that stays at a
row with probability one half, which place rows near that share neighbours. A
round is one join of the edges with the coordinates and one aggregation; only
sums of products reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.hashing import seeded_uniform
from lexisieve.operators.knn import knn_join
from lexisieve.session import materialize


def neighbor_graph(df: DataFrame, id_col: str, vec_col: str, k: int = 10) -> DataFrame:
    """``a, b``: both directions of every pair of which one is among the other's ``k`` nearest."""
    near = knn_join(df, df, id_col, vec_col, k, exclude_self=True).select(F.col("id").alias("a"), F.col("neighbor").alias("b"))
    return near.union(near.select("b", "a")).distinct()


def _dot(df: DataFrame, left: str, right: str):
    return F.sum(F.col(left) * F.col(right))


def spectral_2d(edges: DataFrame, rounds: int = 40, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """``id, x, y`` for every row of the graph, and the two eigenvalues (descending, of the lazy walk).

    With ``d`` the number of neighbours, ``u = sqrt(d)`` is the known leading eigenvector of the symmetric walk
    matrix; ``x`` and ``y`` are kept orthogonal to it and to each other, and have length one. Coordinates are those
    of the walk (divided by ``u``), so that a group without ties to the others is one point.
    """
    degree = edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    state = degree.select("id", F.sqrt("d").alias("u"), (seeded_uniform(seed, F.col("id")) - 0.5).alias("x"),
                          (seeded_uniform(seed + 1, F.col("id")) - 0.5).alias("y"))
    values = [0.0, 0.0]
    links = materialize(edges)

    def orthogonal(rows: DataFrame) -> DataFrame:
        """``x`` orthogonal to ``u``, ``y`` to both, of length one."""
        names = ("u", "x", "y")
        s = rows.agg(*[_dot(rows, a, b).alias(a + b) for i, a in enumerate(names) for b in names[i:]]).first()
        xu, yu = s.ux / s.uu, s.uy / s.uu
        xx = s.xx - xu * s.ux
        yx = (s.xy - yu * s.ux) / xx if xx > 0 else 0.0
        yy = s.yy - yu * s.uy - yx * yx * xx
        x = F.col("x") - xu * F.col("u")
        return rows.select("id", "u", (x / max(xx, 1e-300) ** 0.5).alias("x"), (
            (F.col("y") - yu * F.col("u") - yx * x) / max(yy, 1e-300) ** 0.5).alias("y"))

    state = materialize(orthogonal(materialize(state)))
    for _ in range(rounds):
        sent = links.join(state.select(F.col("id").alias("a"), *[(F.col(c) / F.col("u")).alias(f"s{c}") for c in "xy"]), "a")
        got = sent.groupBy(F.col("b").alias("id")).agg(F.sum("sx").alias("gx"), F.sum("sy").alias("gy"))
        moved = materialize(state.join(got, "id").select(
            "id", "u", *[((F.col(c) + F.col(f"g{c}") / F.col("u")) / 2).alias(c) for c in "xy"],
            F.col("x").alias("ox"), F.col("y").alias("oy")))
        ray = moved.agg(_dot(moved, "x", "ox").alias("x"), _dot(moved, "y", "oy").alias("y")).first()
        values = [ray.x, ray.y]
        state = materialize(orthogonal(moved.select("id", "u", "x", "y")))
    if values[1] > values[0]:
        values, state = values[::-1], state.select("id", "u", F.col("y").alias("x"), F.col("x").alias("y"))
    return state.select("id", *[(F.col(c) / F.col("u")).alias(c) for c in "xy"]), values


def embed_graph(df: DataFrame, vec_col: str, id_col: str, source_col: str, k: int = 10, rounds: int = 40,
                per_source: bool = False) -> DataFrame:
    """``source, id, x, y, degree``: neighbour-graph coordinates of all sources together, or of each alone. Ids are
    numbers, unique over the table. Vectors that are null or hold a null are left out."""
    if per_source:
        names = sorted(r[0] for r in df.select(source_col).distinct().collect())
        return reduce(DataFrame.unionByName, [
            embed_graph(df.where(F.col(source_col) == n), vec_col, id_col, source_col, k, rounds) for n in names])
    edges = materialize(neighbor_graph(df, id_col, vec_col, k))
    placed, _ = spectral_2d(edges, rounds)
    degrees = edges.groupBy(F.col("a").alias(id_col)).agg(F.count(F.lit(1)).alias("degree"))
    return df.select(source_col, id_col).join(placed.withColumnRenamed("id", id_col), id_col).join(degrees, id_col).select(
        source_col, id_col, "x", "y", "degree")
