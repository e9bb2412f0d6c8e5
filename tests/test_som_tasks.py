"""Maps over tasks without rows, long frames and copies."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lexisieve.functions.hashing import seeded
from lexisieve.operators import som
from lexisieve.session import materialize


def vectors(spark, n, copies=0):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).round(3).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def test_tasks_without_rows(spark, tmp_path):
    """A file that is read in more splits than it has row groups has tasks without rows."""
    df = vectors(spark, 300).coalesce(1)
    whole = som.train_map(df, "vec", side=4, rounds=3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert materialize(df).rdd.getNumPartitions() > 1
        split = som.train_map(df, "vec", side=4, rounds=3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    np.testing.assert_allclose(split.codebook, whole.codebook, atol=1e-9)


def test_the_first_codebook_is_that_of_the_lowest_hashes(spark):
    df = vectors(spark, 40, 30)
    text = F.to_json(F.col("vec"))
    ordered = [r.vec for r in df.orderBy(seeded(7, text), text).collect()]
    for side in (2, 5, 7):
        start = som.train_map(df, "vec", side=side, rounds=0, seed=7).codebook
        np.testing.assert_array_equal(start, np.array(ordered)[:side * side])


def test_long_frames_meet_the_codebook_in_blocks():
    rng = np.random.default_rng(2)
    x, codebook = rng.normal(size=(5_000, 4)), rng.normal(size=(4_096, 4))
    tracemalloc.start()
    node, squared = som._nearest(x, codebook)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    few = slice(0, 5_000, 50)
    exact = ((x[few][:, None] - codebook) ** 2).sum(2)
    np.testing.assert_allclose(squared[few], exact.min(1))
    assert (exact[np.arange(100), node[few]] <= exact.min(1) + 1e-12).all()
