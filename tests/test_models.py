import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import functions as F

from lexisieve.functions.fingerprint import add_sparse_vector
from lexisieve.operators import apply, balancing, models


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        y = i % 3 == 0
        own = range(0, 40) if y else range(24, 64)
        rows.append((i, int(y), sorted({int(b) for b in rng.choice(list(own), 8)})))
    df = spark.createDataFrame(rows, "id long, label int, bits array<int>").coalesce(1)
    return add_sparse_vector(df, "bits", 64).cache()


def test_select_tune_save_and_score(spark, labelled, tmp_path):
    path = str(tmp_path / "model")
    table, model = models.train_select(labelled.select("id", "label", "features"), names=["LR", "DT"], draws=1, path=path)
    rows = {r.model: r.auc for r in table.collect()}
    assert set(rows) == {"LR", "DT"} and max(rows.values()) > 0.8
    again, _ = models.train_select(labelled.select("id", "label", "features"), names=["LR", "DT"], draws=1)
    assert {r.model: round(r.auc, 9) for r in again.collect()} == {m: round(a, 9) for m, a in rows.items()}
    scored = models.score_rank(labelled, path, "id", keep=["label"]).orderBy("rank").collect()
    assert [r["rank"] for r in scored] == list(range(1, 121))
    assert all(a.score >= b.score for a, b in zip(scored, scored[1:]))
    assert sum(r.label for r in scored[:30]) > 20


def test_out_of_fold_covers_each_row_once(spark, labelled):
    folded = balancing.stratified_folds(labelled.select("id", "label", "features"), "label", "id", 3)
    out = models.out_of_fold(folded, LogisticRegression(maxIter=5))
    assert out.count() == 120 and out.select("id").distinct().count() == 120
    margin = models.out_of_fold(folded, Pipeline(stages=[LinearSVC(maxIter=3)]))
    assert margin.where("score < 0 or score > 1").count() == 0


def test_grid_reports_each_size_and_model(spark, labelled):
    out = models.model_grid(labelled, "bits", "id", "label", sizes=(16, 64), names=("NB", "KNN"), folds=2)
    rows = {(r.bits, r.model): r.auc for r in out.collect()}
    assert set(rows) == {(16, "NB"), (16, "KNN"), (64, "NB"), (64, "KNN")}
    assert rows[(64, "NB")] > 0.7 and rows[(64, "KNN")] > 0.7
    assert models.best_of_grid(out).first().auc == max(rows.values())


def test_random_search_is_repeatable():
    estimator, values = LogisticRegression(), {"regParam": [1, 2, 3], "maxIter": [1, 2]}
    assert models.param_maps(estimator, values, 3, 7) == models.param_maps(estimator, values, 3, 7)
    assert len(models.param_maps(estimator, values)) == 6 and models.param_maps(estimator, {}) == [{}]


def test_regression(spark):
    df = spark.range(300).select("id", (F.col("id") % 10).alias("x"), (F.col("id") % 10 * 2.0).alias("y"))
    row = models.boosted_regression(df, ["x"], "y", ["id"], depths=(3,), max_iter=3).first()
    assert row.rmse < 2.0


def test_standardise_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, c double")
    rows = models.standardize(df, ["x", "c"]).orderBy("x").collect()
    values = np.array([1, 2, 3, 6.0])
    np.testing.assert_allclose([r.x_std for r in rows], (values - values.mean()) / values.std())
    assert {r.c_std for r in rows} == {0.0}


def test_projection(spark):
    rng = np.random.default_rng(0)
    rows = [(s, i, [float(x) for x in rng.normal(0, 1, 5)]) for s in ("a", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "source string, id long, vec array<double>")
    joint = models.embed_2d(df, "vec", "id", "source").toPandas()
    values = np.array([r[2] for r in rows])
    z = (values - values.mean(0)) / values.std(0)
    top = np.linalg.eigvalsh(z.T @ z / len(z))[::-1][:2]
    np.testing.assert_allclose(sorted(joint[["x", "y"]].var(ddof=0))[::-1], top, rtol=1e-6)
    assert models.embed_2d(df, "vec", "id", "source", per_source=True).count() == 40
    assert models.axis_ranges(models.embed_2d(df, "vec", "id", "source")).first().x_min < 0


def test_mixture_and_cells(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.concatenate([rng.normal(0, 0.1, 60), rng.normal(10, 0.1, 60)])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(998, None), (999, float("nan"))], "id int, v double").coalesce(1)
    rows, table = models.gmm_columns(df, ["v"], ["id"], components=2)
    got = {r.id: r.v_component for r in rows.collect()}
    assert got[998] == got[999] == -1 and got[0] != got[119] and len({got[i] for i in range(60)}) == 1
    means = sorted(r["mean"] for r in table.collect())
    assert abs(means[0]) < 0.2 and abs(means[1] - 10) < 0.2 and all(r.log_std < 0 for r in table.collect())
    assert models.grid_side(100) == math.ceil(math.sqrt(50))
    vecs = df.where("id < 120").selectExpr("id", "array(v) AS vec")
    train, other = models.assign_cells(vecs, vecs, "vec", cells=2)
    assert train.select("cell").distinct().count() == 2 and other.count() == 120


def test_caller_functions(spark):
    def double(frame, by):
        return frame.assign(id=frame["id"] * by)

    assert apply.map_partitions(spark.range(5), double, "id long", by=3).agg(F.sum("id")).first()[0] == 30
    scored = apply.add_score(spark.createDataFrame([("a",), ("b",)], "s string"), lambda: lambda v: v.map({"a": 1.0}), "s")
    assert {r.s: r.score for r in scored.collect()} == {"a": 1.0, "b": -1.0}


def test_boosting_and_mixtures_see_equal_rows_once(spark, monkeypatch):
    """Rows that agree are fitted as one with a weight; the error is still that of all rows."""
    df = spark.range(600).select("id", (F.col("id") % 5).alias("x"), (F.col("id") % 5 * 2.0 + F.col("id") % 2).alias("y"))
    seen = []
    for kind in (models.GBTRegressor, models.GaussianMixture):
        monkeypatch.setattr(kind, "_fit", lambda self, data, fit=kind._fit: (seen.append(data.count()), fit(self, data))[1])
    rmse = models.boosted_regression(df, ["x"], "y", ["id"], depths=(3,), max_iter=3).first().rmse
    assert seen and max(seen) <= 15
    assert abs(rmse - 0.5) < 0.02  # y's noise, which no tree can know
    seen.clear()
    rows, table = models.gmm_columns(df.withColumn("y", F.col("id") % 4 * 10.0), ["y"], ["id"], components=2)
    assert seen == [4] and rows.count() == 600
    assert abs(sum(r.weight for r in table.collect()) - 1) < 1e-6
    centre = sum(r.weight * r["mean"] for r in table.collect())
    assert abs(centre - 15) < 1e-3
