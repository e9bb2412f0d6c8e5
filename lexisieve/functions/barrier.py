"""Keeping Catalyst from repeating a costly expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters cannot be merged into.

    Catalyst pushes a filter below a projection by repeating the projected
    expression wherever the filter names it, which evaluates a costly text or
    array expression several times per row. A generator of one row stops that.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
