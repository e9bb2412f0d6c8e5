"""Mergeable sketches, self-organising maps, neighbour-graph coordinates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisieve.operators import sketches, som, spectral


def test_merged_sketches_are_near_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 13), float(v), int(u)) for i, (v, u) in enumerate(zip(rng.lognormal(size=20_000), rng.integers(0, 3000, 20_000)))]
    rows += [(3, None, None), (3, float("nan"), 5)]
    df = spark.createDataFrame(rows, "day int, v double, u long")
    parts = sketches.sketch_parts(df, {"day": F.col("day")}, ["v"], ["u"], ["u"])
    assert parts.count() == 13
    merged = sketches.merge_parts(parts)
    assert merged.first().n == len(rows)
    found = sketches.percentiles(merged, "v", [0.05, 0.5, 0.95])
    assert all(r.error < 0.02 for r in sketches.rank_errors(df, found, "v").collect())
    exact = df.agg(F.count_distinct("u")).first()[0]
    assert all(abs(r.about - exact) < 0.05 * exact for r in sketches.distinct_counts(merged).collect())
    grouped = sketches.merge_parts(parts.withColumn("week", F.floor(F.col("day") / 7)), ["week"])
    assert sorted(r.n for r in grouped.collect()) == sorted(
        r["count"] for r in df.groupBy(F.floor(F.col("day") / 7)).count().collect())
    both = df.where("day = 1").select("u").intersect(df.where("day = 2").select("u")).count()
    assert abs(sketches.common_values(parts, "u", "day", 1, 2).first()[0] - both) <= 0.1 * both + 5


def blobs(spark, seed=0, each=60):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.2, (each, 4)) for c in (0, 3, 6)])
    rows = [(i, v, int(i // each)) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "id long, vec array<double>, y int"), x


def test_map_errors_fall_and_cells_are_pure(spark):
    df, x = blobs(spark)
    extra = spark.createDataFrame([(900, None, 0), (901, [0.0, None, 0.0, 0.0], 0), (902, [float("nan")] * 4, 0)], df.schema)
    trained = som.train_map(df.union(extra), "vec", rounds=8)
    assert trained.side == som.grid_side(180)
    errors = [e for _, _, e in trained.errors]
    assert all(b < a + 1e-9 for a, b in zip(errors[1:], errors[2:])) and errors[-1] < 0.5 * errors[1]
    again = som.SelfOrganisingMap.from_table(trained.table(spark))
    rows = som.assign_nodes(df.union(extra), again, "vec").collect()
    for r in rows:
        if r.id >= 900:
            assert r.cell is None
        else:
            assert r.cell == ((trained.codebook - x[r.id]) ** 2).sum(1).argmin()
    labels = {}
    for r in rows:
        if r.cell is not None:
            labels.setdefault(r.cell, set()).add(r.y)
    assert all(len(v) == 1 for v in labels.values())
    with pytest.raises(ValueError):
        som.train_map(df.limit(0), "vec")


def test_map_rounds_equal_a_plain_batch_map(spark):
    df, x = blobs(spark, 2, 20)
    one = som.train_map(df, "vec", side=3, rounds=1, last_sigma=0.8)
    start = som.train_map(df, "vec", side=3, rounds=0)
    near = ((x[:, None] - start.codebook) ** 2).sum(2).argmin(1)
    grid = np.array([(i // 3, i % 3) for i in range(9)])
    h = np.exp(-((grid[:, None] - grid) ** 2).sum(2) / (2 * 1.5 ** 2))
    want = np.stack([(h[j, near][:, None] * x).sum(0) / h[j, near].sum() for j in range(9)])
    np.testing.assert_allclose(one.codebook, want, atol=1e-9)


def test_graph_coordinates_are_eigenvectors(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.5, (25, 3)) for c in (0, 1.5, 3)])
    df = spark.createDataFrame([(i, v, "s") for i, v in enumerate(x.tolist())], "id long, vec array<double>, source string")
    edges = spectral.neighbor_graph(df, "id", "vec", 6)
    pairs = {(r.a, r.b) for r in edges.collect()}
    assert pairs == {(b, a) for a, b in pairs}
    placed, values = spectral.spectral_2d(edges, rounds=50)
    w = np.zeros((75, 75))
    for a, b in pairs:
        w[a, b] = 1
    d = w.sum(1)
    lazy = (np.eye(75) + w / np.sqrt(np.outer(d, d))) / 2
    true = np.sort(np.linalg.eigvalsh(lazy))[::-1]
    np.testing.assert_allclose(values, true[1:3], atol=2e-2)
    rows = {r.id: (r.x, r.y) for r in placed.collect()}
    xy = np.array([rows[i] for i in range(75)]) * np.sqrt(d)[:, None]
    np.testing.assert_allclose(xy.T @ xy, np.eye(2), atol=1e-9)
    np.testing.assert_allclose(np.sqrt(d) @ xy, 0, atol=1e-9)
    np.testing.assert_allclose(np.linalg.norm(lazy @ xy[:, 0] - values[0] * xy[:, 0]), 0, atol=0.06)
    assert spectral.embed_graph(df, "vec", "id", "source", 6, rounds=3).columns == ["source", "id", "x", "y", "degree"]


def test_empty_and_infinite_vectors_take_no_part_in_a_map(spark):
    df, _ = blobs(spark, 5, 10)
    odd = spark.createDataFrame([(900, [], 0), (901, [float("inf")] * 4, 0), (902, [0.0, float("-inf"), 0.0, 0.0], 0)], df.schema)
    trained = som.train_map(df.union(odd), "vec", side=3, rounds=2)
    assert np.isfinite(trained.codebook).all()
    cells = {r.id: r.cell for r in som.assign_nodes(df.union(odd), trained, "vec").collect()}
    assert all((c is None) == (i >= 900) for i, c in cells.items())
