"""Session set-up and the two building blocks that need to look at the cluster:
materialising a table and choosing a broadcast by measured size."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a written table (compressed) that we are willing to broadcast.
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "lexisieve", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume. On a cluster the
    master, memory and shuffle settings come from ``spark-submit``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session, or else the context's checkpoint
    directory. It has to be storage that every executor reaches."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir, when the session is built, to a folder shared by all executors")
    return folder


def concurrently(tasks: Sequence[Callable[[], Any]], parallelism: int) -> list:
    """Results of functions without arguments, in order, run by a bounded pool of driver threads. Each starts its own
    Spark jobs, so that small jobs share the cluster."""
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda task: task()), tasks, chunksize=1)


#: Tables being written, by threads that share a session.
_WRITING = {"lock": threading.Lock(), "tables": 0, "before": None}


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query started inside are removed when it has ended, not when the driver happens to collect its
    garbage. The written table has all that comes of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _WRITING["lock"]:
        if not _WRITING["tables"]:
            _WRITING["before"] = spark.conf.get(name, "false")
        _WRITING["tables"] += 1
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _WRITING["lock"]:
            _WRITING["tables"] -= 1
            if not _WRITING["tables"]:
                spark.conf.set(name, _WRITING["before"])


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage, gives later passes a table with column pruning, and
    survives the loss of executors. Shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_end_with_the_write(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring the bytes.

    Call it on a materialised table, whose size is that of its files. A larger
    table is returned as it is, so the join shuffles (with AQE skew handling)
    instead.
    """
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A derived table as the small side of a join: written once, measured, and
    broadcast if it is within bounds, so that the large side is not shuffled."""
    return broadcast_if_bounded(materialize(df), max_bytes)


def plan_bytes(df: DataFrame) -> int:
    """Spark's size estimate of a plan, exact for a table read from files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def compact(df: DataFrame, partition_bytes: int = 16 << 20) -> DataFrame:
    """Merge the partitions of a small table without a shuffle, for iterative
    algorithms that start one job per step."""
    wanted = max(1, plan_bytes(df) // partition_bytes)
    return df.coalesce(wanted) if wanted < default_partitions(df.sparkSession) else df


#: Bytes of a table of sparse vectors (as stored) for one task of a fit. In memory they are some twelve times as large.
VECTOR_BYTES = 1 << 20

#: Bytes of a table (as stored) for one task of costly text expressions.
TEXT_BYTES = 8 << 20


def spread(df: DataFrame, column: str) -> DataFrame:
    """Redistribute a table whose scan splits hold too much for one task each.

    Text expressions are heavy on the CPU: a small table would leave most cores
    idle, and the splits of a large one, 128 MB or a row group, would be long
    tasks. There is a task for every ``TEXT_BYTES`` of the table, two per core
    at least.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores * 2, -(-plan_bytes(df) // TEXT_BYTES)), column) if cores > 1 else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs started inside, where rows hold long texts or arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
