from pyspark.sql import functions as F

from lexisieve.operators import dedup


def keys(df, column="k"):
    return sorted((r[column] for r in df.collect()), key=lambda v: (v is not None, v))


def frame(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k string, id int")


def test_first_is_the_lowest_id_and_nulls_are_one_key(spark):
    df = frame(spark, ["b", "a", "a", None, None])
    assert {(r.k, r.id) for r in dedup.distinct_by(df, "k", "id").collect()} == {("b", 0), ("a", 1), (None, 3)}
    assert keys(dedup.distinct_by(df, "k", "id", drop_null_keys=True)) == ["a", "b"]


def test_difference_with_null_keys(spark):
    a, b = frame(spark, ["a", "b", None, None]), frame(spark, ["b", None])
    assert keys(dedup.difference_by_key(a, b, "k", "id")) == ["a"]
    assert keys(dedup.difference_by_key(a, frame(spark, ["b"]), "k", "id")) == [None, "a"]


def test_difference_unique_removes_every_copy(spark):
    a = frame(spark, ["x", "x", "y", "z"])
    assert keys(dedup.difference_unique(a, frame(spark, ["z"]), "k")) == ["y"]


def test_subtract_and_sets(spark):
    a, b = frame(spark, ["a", "b", None]), frame(spark, ["b", "b", None])
    assert keys(dedup.subtract_by_id(a, b, "k")) == ["a"]
    assert keys(dedup.except_rows(a.select("k"), b.select("k"))) == ["a"]
    assert keys(dedup.intersect_rows(a.select("k"), b.select("k"))) == [None, "b"]


def test_hot_key(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    assert dedup.distinct_by(df, "k", "id").count() == 20001


def test_label_union_and_report(spark):
    df = dedup.label_union([(frame(spark, ["a"]), 1), (frame(spark, ["b", "b"]), 0)])
    assert sorted(r.LABEL for r in df.collect()) == [0, 0, 1]
    row = dedup.generation_report(df, "k", F.col("k") == "b").first()
    assert (row.n_generated, row.n_unique_valid) == (3, 1) and abs(row.validity - 1 / 3) < 1e-12
