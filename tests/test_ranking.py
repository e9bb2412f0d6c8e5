import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexisieve.operators import ranking


def scored(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.2).astype(int)
    score = np.round(rng.normal(label, 1.0), 1)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "label": label, "score": score}))


@pytest.mark.parametrize("ascending", [False, True])
def test_auc_and_average_precision(spark, ascending):
    df = scored(spark)
    order = df.toPandas().sort_values(["score", "id"], ascending=[ascending, True]).reset_index(drop=True)
    place = np.flatnonzero(order["label"] == 1) + 1
    seen = np.arange(1, len(place) + 1)
    roc = 1 - ((place - seen) / (len(place) * (len(order) - len(place)))).sum()
    row = ranking.ranking_auc(df, "score", "label", "id", ascending).first()
    assert abs(row.auc_roc - roc) < 1e-12 and abs(row.auc_prc - (seen / place).mean()) < 1e-12


def test_enrichment_rounds_half_even_and_handles_an_empty_top(spark):
    df = spark.createDataFrame([(i, int(i < 3), float(50 - i)) for i in range(50)], "id int, label int, score double")
    rows = {r.fraction: r for r in ranking.enrichment_factor(df, "score", "label", "id").collect()}
    assert rows[0.01].top == 0 and rows[0.01].ef is None
    assert rows[0.05].top == 2 and abs(rows[0.05].ef - 50 / 3) < 1e-9
    assert rows[0.15].top == 8 and rows[0.15].hits == 3


def test_roc_points_end_at_one(spark):
    rows = ranking.roc_curve(scored(spark), "score", "label").toPandas().sort_values(["fpr", "tpr"])
    assert rows.iloc[0].tolist()[:2] == [0, 0] and rows.iloc[-1].tolist()[:2] == [1, 1]
    assert (rows["tpr"].diff().dropna() >= -1e-12).all()


@pytest.mark.parametrize("chunk", [5, 64, 100000])
def test_rolling_mean_over_chunks(spark, chunk):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"step": np.arange(600), "m": np.where(np.arange(600) % 3 == 0, "hot", rng.choice(["a", "b"], 600)),
                          "v": rng.normal(size=600)})
    want = frame.sort_values("step").groupby("m")["v"].rolling(5, min_periods=1).mean().reset_index(level=0, drop=True)
    out = ranking.rolling_mean(spark.createDataFrame(frame), "m", ["step"], "v", 5, chunk=chunk).toPandas()
    assert len(out) == 600
    np.testing.assert_allclose(out.sort_values("step")["rolling_mean"].to_numpy(), want.sort_index().to_numpy(), atol=1e-12)


def test_centred_and_batch_means(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "b int, v double")
    assert sorted(r.centered for r in ranking.centered(df, "b", "v").collect()) == [-0.5, 0.0, 0.5]
    assert {r.b: r.mean_reward for r in ranking.batch_means(df, "b", "v").collect()} == {1: 1.5, 2: 5.0}


def test_mask_and_collate(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id int, p double")
    assert [(r.p, r.p_missing) for r in ranking.missing_mask(df, ["p"]).orderBy("id").collect()] == [(0.0, 1), (3.0, 0)]
    batch = spark.createDataFrame([(0, 1, [1]), (0, 2, [1, 2, 3]), (0, 3, [4]), (1, 4, [5])], "b int, id int, ids array<int>")
    rows = {r.id: r for r in ranking.collate(batch, "b", "ids", "id", 9).collect()}
    assert [rows[i].position for i in (2, 1, 3)] == [1, 2, 3] and rows[1].ids == [1, 9, 9] and rows[4].ids == [5]


def test_rank(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5)], "id int, s double")
    assert {r.id: r["rank"] for r in ranking.rank_scored(df, [F.desc("s"), "id"]).collect()} == {2: 1, 1: 2, 3: 3}
