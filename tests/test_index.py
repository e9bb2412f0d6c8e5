import random

import pytest
from pyspark.sql import functions as F

from lexisieve.operators import index


@pytest.mark.parametrize("n", [1, 4, 17])
def test_global_rank_does_not_depend_on_partitions(spark, partitions, n):
    partitions(n)
    values = [random.Random(1).randrange(50) if i % 3 else 7 for i in range(2000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, id int").repartition(5)
    rows = index.global_rank(df, ["v", F.desc("id")], unique=True).collect()
    want = {(v, i): k for k, (v, i) in enumerate(sorted(((v, i) for i, v in enumerate(values)), key=lambda t: (t[0], -t[1])))}
    assert {(r.v, r.id): r.idx for r in rows} == want


def test_one_hot_value_is_still_numbered_without_gaps(spark):
    df = spark.range(3000).select(F.lit(1).alias("v"))
    assert sorted(r.idx for r in index.global_rank(df, ["v"]).collect()) == list(range(3000))


def test_grouped_rank_and_sizes(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1), (None, 3), (None, 4)], "g string, x int")
    rows = index.grouped_rank(df, ["g"], [F.desc("x")], size="n").collect()
    a = {r.x: r.idx for r in rows if r.g == "a"}
    assert a == {x: 499 - x for x in range(500)}
    assert {(r.x, r.idx, r.n) for r in rows if r.g is None} == {(4, 0, 2), (3, 1, 2)}


def test_running_sums(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("w"))
    rows = {r.id: r.s for r in index.running_sums(df, ["id"], {"s": F.col("w")}, unique=True).collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert rows[i] == total


def test_add_index_width_and_prefix(spark):
    df = spark.createDataFrame([(i,) for i in range(12)], "k int")
    assert [r.ID for r in index.add_index(df, ["k"]).orderBy("k").limit(3).collect()] == ["00", "01", "02"]
    assert index.add_index(df, ["k"], prefix="pre").orderBy("k").first().ID == "pre_00"


def test_top_n_both_ways(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v"))
    small = [r.v for r in index.top_n(df, ["v"], 10).collect()]
    large = sorted(r.v for r in index.top_n(df, ["v"], 10, heap_limit=1).collect())
    assert small == large
