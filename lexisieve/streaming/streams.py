"""Streams over files that arrive in a folder, with the batch expressions."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.operators.dedup import distinct_by
from lexisieve.operators.index import top_n
from lexisieve.plans.curate import clean_rows
from lexisieve.sources.files import glob


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def write_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """Process what is there now, append it to ``path`` and read that back. The
    checkpoint makes a rerun take up where the last one ended."""
    query = (
        df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def process_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", most: int | None = None) -> int:
    """Go through waiting micro-batches (one file each, if the stream was read with ``max_files=1``) and stop after
    ``most`` of them. The next call takes up behind the last finished one, so every row is written once. Returns the
    number of batches finished by now."""
    query = (
        df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(path))
    spark, before = df.sparkSession, None
    try:
        while True:
            ended = query.awaitTermination(0.05)
            done = len(glob(spark, f"{checkpoint.rstrip('/')}/commits/[0-9]*"))
            before = done if before is None else before
            if ended or (most is not None and done >= before + most):
                break
    finally:
        query.stop()
    return len(glob(spark, f"{checkpoint.rstrip('/')}/commits/[0-9]*"))


def state_rows(df: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, int]:
    """As :func:`write_available`, and how many rows the state holds after the run."""
    query = (
        df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(path))
    query.awaitTermination()
    held = [sum(int(o["numRowsTotal"]) for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    return df.sparkSession.read.schema(df.schema).parquet(path), held[-1] if held else 0


def collect_until(stream: DataFrame, path: str, checkpoint: str, wanted: int, key: Callable[[], Column], valid: Column,
                  order: str) -> DataFrame:
    """The first ``wanted`` valid rows with distinct keys, in order of arrival: by micro-batch, then by ``order``.

    The rows kept so far are a table in ``path`` with a folder per micro-batch; its keys join the next batch. A batch
    that is run again replaces its own folder, so no row is counted twice. The stream stops when enough rows are kept.
    Null keys are left out. The checkpoint makes a rerun after a failure take up where the last one ended; once enough
    rows are kept, a rerun reads nothing. Rows that arrive behind the last one kept are passed over, so a larger number
    needs a new checkpoint and path.
    """
    spark, schema = stream.sparkSession, stream.schema
    enough = threading.Event()

    def kept(batch: int | None = None) -> DataFrame:
        found = [p for p in glob(spark, f"{path.rstrip('/')}/batch=*/_SUCCESS")
                 if batch is None or int(p.split("batch=")[1].split("/")[0]) < batch]
        folders = [p.rsplit("/", 1)[0] for p in found]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def take(rows: DataFrame, batch: int) -> None:
        before = kept(batch)
        missing = wanted - before.count()
        if missing > 0:
            keyed = rows.where(valid).withColumn("__key", key()).where(F.col("__key").isNotNull())
            new = keyed.join(before.select(key().alias("__key")), "__key", "left_anti")
            first = top_n(distinct_by(new, "__key", order).drop("__key"), [order], missing)
            first.select(*schema.names).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
            missing -= kept(batch + 1).count() - before.count()
        if missing <= 0:
            enough.set()

    if kept().count() >= wanted:
        return kept()
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        while not query.awaitTermination(0.05) and not enough.is_set():
            pass
    finally:
        query.stop()
    return kept()


def curate_stream(stream: DataFrame, text_col: str = "SMILES", known: Sequence[str] | None = None) -> DataFrame:
    """Stateless cleaning of arriving rows."""
    return clean_rows(stream, text_col, known)


def distinct_stream(stream: DataFrame, keys: Sequence[str], time_col: str | None = None,
                    delay: str | None = None) -> DataFrame:
    """First sight of each key. Without a watermark the state keeps every key
    for ever; with ``delay`` it keeps only keys seen within that time."""
    if delay is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def validity_counts(stream: DataFrame, valid: Column) -> DataFrame:
    """Running numbers of generated and valid rows (update or complete mode)."""
    return stream.agg(F.count(F.lit(1)).alias("n_generated"), F.count(F.when(valid, 1)).alias("n_valid"))


def metric_windows(stream: DataFrame, time_col: str, metric: str, value: str, size: str,
                   slide: str | None = None, gap: str | Column | None = None, delay: str = "10 minutes") -> DataFrame:
    """Mean of each metric per tumbling, sliding or (with ``gap``) session
    window. ``gap`` may be a column, such as an interval that differs by metric. A session ends a gap after its last
    row, and rows up to that moment join it. Rows later than ``delay`` are dropped. The partial aggregation runs
    before the shuffle, so one busy metric does not fill one task."""
    frame = F.session_window(time_col, gap) if gap is not None else F.window(time_col, size, slide or size)
    return (
        stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).groupBy(frame.alias("w"), F.col(metric).alias("metric"))
        .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.end").cast("timestamp_ntz").alias("window_end"), "metric", "mean", "n"))
