import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisieve.operators import profiling


def test_percentiles(spark):
    rng = random.Random(0)
    groups = {"a": [1, 2, 2, 3, 10, 11], "b": [rng.choice([5.0, rng.random()]) for _ in range(501)], "c": [4.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    out = profiling.exact_percentiles(df, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    for r in out.collect():
        for name, p in (("p5", 5), ("p50", 50), ("p95", 95)):
            assert r[name] is None if r.g == "none" else abs(r[name] - np.percentile(groups[r.g], p)) < 1e-9


def test_summary_table(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 3, 10, 11]], "x int")
    row = profiling.describe_columns(df, ["x"]).first()
    assert (row["count"], row["std"], row.p5, row.p50, row.p95, row["min"], row["max"]) == (6, 4.45, 1.25, 2.5, 10.75, 1, 11)
    assert profiling.describe_columns(df, ["x"], approximate=True).first().p50 == 2.0


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(v, 3.0) for v in [0.0, 0.1, 5.0, 10.0]], "x double, same double")
    rows = profiling.histogram(df, ["x", "same"], 10).collect()
    assert [r.n for r in sorted((r for r in rows if r.descriptor == "x"), key=lambda r: r.bin)] == [2, 0, 0, 0, 0, 1, 0, 0, 0, 1]
    assert [r.n for r in sorted((r for r in rows if r.descriptor == "same"), key=lambda r: r.bin)] == [4] + [0] * 9


def test_unpivot_keeps_nulls_and_totals(spark):
    a = spark.createDataFrame([(1.0, None), (2.0, 5.0)], "x double, y double")
    b = spark.createDataFrame([(3.0, 7.0)], "x double, y double")
    long = profiling.unpivot_compare(a, b, ["x", "y"])
    assert long.count() == 6 and long.where("value is null").count() == 1
    rows = {(r.descriptor, r.data): r for r in profiling.compare_distributions(long).collect()}
    assert rows[("x", "all")]["count"] == 3 and rows[("x", "all")].p50 == 2.0 and rows[("y", "Real")]["count"] == 1
    assert len(rows) == 6


def test_vocabulary_order_and_specials(spark):
    df = spark.createDataFrame([(["b", "a"],), (["é", "a", "B"],)], "t array<string>")
    rows = {r.token: r.id for r in profiling.build_vocab(df, "t").collect()}
    assert rows == {"B": 0, "a": 1, "b": 2, "é": 3, "<bos>": 4, "<eos>": 5, "<pad>": 6, "<unk>": 7}
    with pytest.raises(Exception, match="special token"):
        profiling.build_vocab(spark.createDataFrame([(["<pad>"],)], "t array<string>"), "t").collect()


def test_report(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2, "y int, p int")
    rows = {r["class"]: r for r in profiling.classification_report(df, "y", "p").collect()}
    assert rows[1].precision == 0.6 and rows[1].recall == 0.75 and rows[1].support == 4
    assert abs(rows[1].f1 - 2 * 0.6 * 0.75 / 1.35) < 1e-12 and abs(rows[1].geo_mean - math.sqrt(0.75 * 4 / 6)) < 1e-12


def test_conditional_entropy_and_order(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (0, 0)], "t int, u int")
    df = df.withColumn("w", F.lit(-1)).withColumn("same", F.col("t"))
    rows = {r.variable: r.score for r in profiling.conditional_entropy(df, ["t"], ["u", "w", "same"]).collect()}
    assert abs(rows["u"] - 0.3819085) < 1e-7 and rows["w"] == 0.0 and abs(rows["same"]) < 1e-12
    scores = spark.createDataFrame(
        [(t, f"T{t}", u, f"U{u}", s) for t, u, s in
         [(0, 0, .1), (0, 1, .2), (0, 2, .3), (0, 3, .9), (1, 0, .5), (1, 1, .5), (1, 2, .3), (1, 3, .1)]],
        "t_no int, target string, u_no int, variable string, score double")
    placed = {(r.target, r.member): r.position for r in profiling.entropy_order(scores).collect()}
    assert placed == {("T0", "T0"): 0, ("T1", "T1"): 0, ("T0", "U0"): 1, ("T0", "U1"): -1, ("T0", "U2"): 2, ("T1", "U3"): 1}


def test_cell_purity(spark):
    train = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (3, 0), (4, 0), (4, 1), (4, 2)], "c int, y int")
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "c int")
    got = {r.c: round(r.score, 6) for r in profiling.cell_purity(train, rows, "c", "y").collect()}
    assert got == {1: 0.666667, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_property_columns(spark):
    df = spark.createDataFrame([("a", "C", 1.0, 2)], "ID string, SMILES string, p double, q int")
    row = profiling.property_matrix(df).first()
    assert row.properties == [1.0, 2.0] and row.property_num == 2
    assert profiling.metric_means(df, "ID", "q").first()["mean"] == 2.0
