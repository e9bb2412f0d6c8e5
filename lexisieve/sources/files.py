"""Paths and small file facts through the Hadoop FileSystem API, so that they
work on any storage Spark can read."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    hadoop_path, fs = _path(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(hadoop_path) or [])


def first_line(spark: SparkSession, path: str) -> str:
    """First line of one (possibly gzipped) text file."""
    row = spark.read.text(path).first()
    return "" if row is None else row[0]


def base_name(path: str) -> str:
    """File name without folder, ``.gz`` and extension."""
    if path.endswith(".gz"):
        path = path[: -len(".gz")]
    return os.path.splitext(os.path.basename(path))[0]


def file_format(path: str) -> str:
    """Extension without ``.gz``; ``ism`` is the same as ``smi``."""
    if path.endswith(".gz"):
        path = path[: -len(".gz")]
    extension = os.path.splitext(os.path.basename(path))[1].lstrip(".")
    return "smi" if extension == "ism" else extension


def name_column(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.gz$", "")
    return F.regexp_replace(bare, r"(.)\.[^.]*$", "$1")


def format_column(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.gz$", "")
    extension = F.regexp_extract(bare, r".\.([^.]*)$", 1)
    return F.when(extension == "ism", "smi").otherwise(extension)


def with_file_identity(df: DataFrame) -> DataFrame:
    """Add ``file_name`` and ``file_format`` of the file each row came from."""
    path = F.col("_metadata.file_path")
    return df.select("*", name_column(path).alias("file_name"), format_column(path).alias("file_format"))


def input_facts(spark: SparkSession, path: str) -> str:
    """Paths, lengths and modification times of the files of an input, one line each, in order of path: a changed
    input has other facts. Only names are read."""
    hadoop_path, fs = _path(spark, path)
    lines = []
    for status in fs.globStatus(hadoop_path) or []:
        found = fs.listFiles(status.getPath(), True)
        while found.hasNext():
            one = found.next()
            lines.append(f"{one.getPath()}\t{one.getLen()}\t{one.getModificationTime()}")
    return "\n".join(sorted(lines))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it exists."""
    hadoop_path, fs = _path(spark, path)
    out = fs.create(hadoop_path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if there is none."""
    if not exists(spark, path):
        return None
    hadoop_path, fs = _path(spark, path)  # Spark's readers skip names with an underscore in front
    stream = fs.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
