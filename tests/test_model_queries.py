"""The registered model queries do the whole job: every classifier, size, fold, parameter and iteration."""

import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from lexisieve.operators import models

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


def points():
    return {name: len(models.param_maps(*pair)) for name, pair in models.classifiers().items()}


def test_grid_has_every_size_classifier_and_parameter(spark, monkeypatch):
    folds = []

    def predictions(df, *rest, **named):
        folds.append(df.select("fold").distinct().count())
        return df.select("id", "label", "fold", F.rand(1).alias("score"))

    monkeypatch.setattr(models, "out_of_fold", predictions)
    monkeypatch.setattr(models, "_knn_out_of_fold", lambda df, *rest: predictions(df).crossJoin(
        F.broadcast(df.sparkSession.range(1, 10).withColumnRenamed("id", "k"))))
    got = {(r.bits, r.model): r["count"] for r in QUERIES["model_grid"](spark, SF).groupBy("bits", "model").count().collect()}
    names = ("RF", "SVM", "NB", "DT", "LR")
    assert got == {(b, n): points()[n] for b in models.FINGERPRINT_SIZES for n in names} | {(b, "KNN"): 9 for b in models.FINGERPRINT_SIZES}
    assert set(folds) == {5}


def test_selection_tunes_every_classifier(spark, monkeypatch):
    class Validator:
        def __init__(self, estimatorParamMaps, numFolds, **rest):
            assert numFolds == 5
            self.avgMetrics, self.bestModel = [0.5] * len(estimatorParamMaps), None

        def fit(self, data):
            assert data.select("fold").distinct().count() == 5
            return self

    monkeypatch.setattr(models, "CrossValidator", Validator)
    assert {r.model: r["count"] for r in QUERIES["train_select"](spark, SF).groupBy("model").count().collect()} == points()


def test_iterations_are_not_cut(spark):
    made = {name: estimator for name, (estimator, _) in models.classifiers().items()}
    for name in ("GBT", "SVM", "LR"):
        assert made[name].getMaxIter() == type(made[name])().getMaxIter()


def test_boosting_tries_every_depth(spark, monkeypatch):
    given = inspect.signature(models.boosted_regression).parameters
    iterations = []
    real = models.GBTRegressor
    monkeypatch.setattr(models, "GBTRegressor", lambda **named: iterations.append(named["maxIter"]) or real(**named))
    rows = QUERIES["gbt_rmse"](spark, SF).collect()
    assert [r.max_depth for r in rows] == list(given["depths"].default) and all(r.rmse > 0 for r in rows)
    assert iterations == [50] == [given["max_iter"].default]


def test_mixtures_and_their_parameters(spark, monkeypatch):
    iterations = []
    real = models.GaussianMixture
    monkeypatch.setattr(models, "GaussianMixture", lambda **named: iterations.append(named["maxIter"]) or real(**named))
    rows = QUERIES["gmm_parameters"](spark, SF).collect()
    for column in ("l_extendedprice", "l_quantity"):
        own = [r for r in rows if r.column == column]
        assert len(own) == 10 and sum(r.weight for r in own) == pytest.approx(1)
    assert iterations == [100, 100]
