import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.plans.curate import clean_rows
from lexisieve.streaming import streams


def write_files(df, path, n):
    df.repartition(n).write.parquet(str(path))


def test_curation_equals_batch(spark, tmp_path):
    texts = ["CCO", "C(C", "CC.OOO", "ClO", "[13CH3]CC", "CX", None, "c1ccccc1"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "ID long, SMILES string")
    write_files(df, tmp_path / "in", 6)
    stream = streams.curate_stream(streams.read_stream(spark, str(tmp_path / "in"), df.schema, max_files=2))
    out = streams.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in clean_rows(df).collect()}
    # a second run finds nothing new
    again = streams.write_available(streams.curate_stream(
        streams.read_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert again.count() == out.count()


def test_distinct_across_files(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 37).alias("k"))
    write_files(df, tmp_path / "in", 5)
    stream = streams.distinct_stream(streams.read_stream(spark, str(tmp_path / "in"), df.schema, max_files=1), ["k"])
    out = streams.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.k for r in out.collect()) == list(range(37))


def moment(minutes):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minutes)


EVENTS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("m", T.StringType()), T.StructField("v", T.DoubleType())])


def run_windows(spark, tmp_path, batches, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(moment(t), m, float(v)) for t, m, v in rows], EVENTS).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        stream = streams.metric_windows(streams.read_stream(spark, str(tmp_path / "in"), EVENTS), "ts", "m", "v", **options)
        out = streams.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    return {((r.window_start - moment(0)).total_seconds() / 60, r.metric): (r["mean"], r.n) for r in out.collect()}


def test_tumbling_windows_drop_late_rows(spark, tmp_path):
    batches = [[(1, "a", 1), (2, "a", 3), (2, "b", 5), (25, "a", 9)], [(3, "a", 100), (22, "a", 1)], [(60, "a", 0)]]
    got = run_windows(spark, tmp_path, batches, size="10 minutes", delay="5 minutes")
    # the row at minute 3 arrives after the watermark (25 - 5 = 20) has closed its window
    assert got == {(0.0, "a"): (2.0, 2), (0.0, "b"): (5.0, 1), (20.0, "a"): (5.0, 2)}


def test_sliding_and_session_windows(spark, tmp_path):
    rows = [[(1, "a", 1), (6, "a", 3)], [(90, "a", 0)]]
    sliding = run_windows(spark, tmp_path / "s", rows, size="10 minutes", slide="5 minutes", delay="1 minute")
    assert sliding == {(-5.0, "a"): (1.0, 1), (0.0, "a"): (2.0, 2), (5.0, "a"): (3.0, 1)}
    session = run_windows(spark, tmp_path / "g", rows, size="", gap="8 minutes", delay="1 minute")
    assert session == {(1.0, "a"): (2.0, 2)}


def test_watermarked_distinct_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(moment(0), "a", 1.0), (moment(1), "a", 2.0), (moment(2), "b", 1.0)], EVENTS)
    write_files(df, tmp_path / "in", 2)
    stream = streams.read_stream(spark, str(tmp_path / "in"), EVENTS)
    out = streams.write_available(streams.distinct_stream(stream, ["m"], "ts", "1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.m for r in out.collect()) == ["a", "b"]
    counts = streams.validity_counts(stream, F.col("v") > 1)
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert tuple(spark.table("counts").first()) == (3, 1)


def test_sessions_with_a_gap_per_metric(spark, tmp_path):
    gap = F.when(F.col("m") == "a", "5 minutes").otherwise("20 minutes")
    batches = [[(0, "a", 1), (4, "a", 3), (9, "a", 5), (15, "a", 7), (0, "b", 1), (18, "b", 2)], [(36, "b", 3), (300, "c", 1)],
               [(16, "a", 99), (301, "c", 1), (900, "c", 1)]]
    got = run_windows(spark, tmp_path, batches, size="", gap=gap, delay="30 minutes")
    assert got[(0, "a")] == (3, 3)  # 4 + 5 = 9: up to that moment a row joins
    assert got[(15, "a")] == (7, 1)  # the row at 16 came too late
    assert got[(0, "b")] == (2, 3)


def test_bounded_distinct_forgets_and_drops_late_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType())])
    batches = [[("a", 0), ("a", 5), ("b", 1)], [("a", 8), ("c", 200)], [("a", 210), ("b", 3), ("b", 205)], [("d", 1000)]]
    held = []
    for rows in batches:
        spark.createDataFrame([(k, moment(t)) for k, t in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.distinct_stream(streams.read_stream(spark, str(tmp_path / "in"), schema, max_files=1), ["k"], "ts", "30 minutes")
        out, rows_held = streams.state_rows(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        held.append(rows_held)
    seen = sorted((r.k, (r.ts - moment(0)).total_seconds() / 60) for r in out.collect())
    # a at 8 is a repetition; after 200 the state has forgotten a and b; b at 3 comes too late
    assert [k for k, _ in seen] == ["a", "a", "b", "b", "c", "d"] and ("b", 3.0) not in seen and ("a", 210.0) in seen
    assert held[0] == 2 and held[-1] <= 1


def test_collect_until_enough_goes_on_after_a_stop(spark, tmp_path):
    schema = "id long, t string, ok boolean"
    for rows in ([(3, "x", True), (1, "x", True), (2, "y", False)], [(5, "x", True), (4, "z", True), (6, None, True)],
                 [(9, "u", True), (8, "v", True), (7, "w", True)], [(10, "s", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(wanted, place):
        stream = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files=1)
        kept = streams.collect_until(stream, str(tmp_path / place / "kept"), str(tmp_path / place / "state"), wanted, lambda: F.col("t"), F.col("ok"), "id")
        return sorted(r.id for r in kept.collect())

    assert run(3, "a") == [1, 4, 7]
    assert run(3, "a") == [1, 4, 7]
    assert run(100, "b") == [1, 4, 7, 8, 9, 10]


def test_files_one_after_another(spark, tmp_path):
    df = spark.range(60)
    for k in range(6):
        df.where(F.col("id") % 6 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema, max_files=1)
    first = streams.process_files(stream, str(tmp_path / "out"), str(tmp_path / "state"), most=2)
    assert 2 <= first
    assert streams.process_files(stream, str(tmp_path / "out"), str(tmp_path / "state")) == 6
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))
