"""Helpers of the subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lexisieve.session import arrow_rows as arrow_rows
from lexisieve.session import shared_dir

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_size(items: list, sizes: list[int], limit: int) -> Iterator[list]:
    """Consecutive runs of ``items`` whose sizes sum to ``limit`` at most, or one larger item."""
    run, total = [], 0
    for item, size in zip(items, sizes):
        if run and total + size > limit:
            yield run
            run, total = [], 0
        run.append(item)
        total += size
    if run:
        yield run
