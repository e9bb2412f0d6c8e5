"""Fits of one grid run side by side over a short plan, and steps that they share run once."""

import threading

import pytest
from pyspark.sql import functions as F

from lexisieve.functions.fingerprint import add_sparse_vector
from lexisieve.operators import models


@pytest.fixture(scope="module")
def bits(spark):
    rows = [(i, i % 2, [i % 7, 8 + i % 2 * 4 + i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, "id long, label int, bits array<int>").coalesce(1).cache()


def test_grid_fits_folds_side_by_side_over_checkpoints(bits, monkeypatch):
    met, plans = threading.Barrier(3), []

    class Constant:
        def fit(self, df):
            met.wait(60)  # the models of all three folds are being fitted
            plans.append(df.inputFiles())
            return self

        def transform(self, df):
            return df.withColumn("rawPrediction", models.array_to_vector(F.array(F.lit(0.0), F.col("label"))))

    monkeypatch.setattr(models, "_pipeline", lambda *_: Constant())
    rows = models.model_grid(bits, "bits", "id", "label", sizes=(16,), names=("NB",), folds=3).collect()
    assert [(r.bits, r.model, r.auc) for r in rows] == [(16, "NB", 1.0)]
    assert plans == [[], [], []]  # no table's files in the plan that every iteration sends out


def test_selection_shares_what_points_have_in_common(bits, monkeypatch):
    met, fitted = threading.Barrier(2), []
    kind, search = models.VarianceThresholdSelector, models.CrossValidator
    monkeypatch.setattr(kind, "_fit", lambda self, df, fit=kind._fit: (fitted.append(1), fit(self, df))[1])
    monkeypatch.setattr(search, "_fit", lambda self, df, fit=search._fit: (met.wait(60), fit(self, df))[1])
    data = add_sparse_vector(bits, "bits", 16).select("id", "label", "features")
    table, model = models.train_select(data, folds=2, names=["NB", "DT"], draws=None)
    assert {r.model: r["count"] for r in table.groupBy("model").count().collect()} == {"NB": 1, "DT": 3}
    assert len(fitted) == 2 * (2 + 1)  # a classifier's folds and its last fit, not each of its points
    assert model.transform(data).count() == 60
