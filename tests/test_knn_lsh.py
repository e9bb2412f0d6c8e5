import numpy as np
import pytest

from lexisieve.operators import knn, knn_lsh


def vectors(spark, array, start=0):
    return spark.createDataFrame([(i + start, [float(x) for x in v]) for i, v in enumerate(array)], "id long, vec array<double>")


def clustered(seed, clusters, each, length, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, length))
    return np.concatenate([c + rng.normal(0, spread, (each, length)) for c in centers])


def test_tree_parts_the_sample_and_probes_start_at_the_own_leaf():
    x = clustered(0, 16, 40, 6)
    tree = knn_lsh.Tree.fit(x, 4, 3)
    leaves = tree.leaves(x)
    assert np.bincount(leaves, minlength=16).max() <= 320
    best, penalty = tree.probes(x, 16)
    assert (best[:, 0] == leaves).all() and (penalty[:, 0] == 0).all()
    assert (np.sort(best, axis=1) == np.arange(16)).all() and (np.diff(penalty, axis=1) >= 0).all()
    again = knn_lsh.Tree.unpacked(*tree.packed())
    assert (again.leaves(x) == leaves).all()


@pytest.mark.parametrize("leaf_rows,most_levels", [(64, 10), (16, 2)])
def test_recall_is_reached_with_few_probes(spark, monkeypatch, leaf_rows, most_levels):
    """With two binary levels a tree, leaves are trees below trees below trees."""
    monkeypatch.setattr(knn_lsh, "MOST_LEVELS", most_levels)
    x = clustered(1, 40, 40, 16)
    x = np.concatenate([x, x[0] + np.random.default_rng(5).normal(0, 0.01, (800, 16))])  # a third in one dense place
    points = vectors(spark, x)
    queries = points.where("id % 5 = 0")
    probes = []
    real = knn_lsh.ProjectionIndex.probes_for
    monkeypatch.setattr(knn_lsh.ProjectionIndex, "probes_for",
                        lambda self, *a: probes.append((real(self, *a), len(self.below))) or probes[0][0])
    found = knn_lsh.knn_lsh(queries, points, "id", "vec", 5, exclude_self=True, leaf_rows=leaf_rows).cache()
    exact = knn.knn_join(queries, points, "id", "vec", 5, exclude_self=True)
    row = knn_lsh.recall_of(found, exact).first()
    assert row.n_queries == 480 and row.n_neighbors == 2400 and row.recall >= 0.9
    assert found.groupBy("id").count().where("count != 5").count() == 0
    assert probes[0][0] <= 16 and (probes[0][1] >= 2 or most_levels == 10)


def test_copies_nulls_and_empty_sides(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(60, [5.0, 5.0]), (61, None), (62, [None, 1.0])]
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {r.id: [] for r in points.collect()}
    for r in sorted(knn_lsh.knn_lsh(points, points, "id", "vec", 3, exclude_self=True, leaf_rows=4).collect()):
        got[r.id].append(r.neighbor)
    assert got[0] == [1, 2, 3] and got[1] == [0, 2, 3] and got[49] == [0, 1, 2] and got[60] == [0, 1, 2]
    assert got[61] == got[62] == []
    assert knn_lsh.knn_lsh(points.limit(0), points, "id", "vec", 3).count() == 0
    assert knn_lsh.knn_lsh(points, points.limit(0), "id", "vec", 3).count() == 0
