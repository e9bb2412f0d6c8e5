"""Where a caller's Python meets a table: partitions and scores.
A domain toolkit (a chemistry library, say) is plugged in here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_partitions(df: DataFrame, fn: Callable[..., pd.DataFrame], schema, **kwargs) -> DataFrame:
    """Apply a frame-to-frame function to Arrow batches, extra arguments bound."""
    bound = partial(fn, **kwargs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield bound(batch)

    return df.mapInPandas(run, schema)


def scorer(load: Callable[[], Callable[[pd.Series], pd.Series]], default: float = -1.0):
    """A score column from a model that ``load`` reads once per task, not once
    per row. Missing scores become ``default``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            yield pd.Series(model(values), dtype="float64").fillna(default)

    return score


def add_score(df: DataFrame, load, column: Column | str, default: float = -1.0, out: str = "score") -> DataFrame:
    return df.withColumn(out, scorer(load, default)(column))

