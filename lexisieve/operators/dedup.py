"""Distinct rows, differences and unions by key.

"First" always means the lowest value of an explicit order column. Grouping is
by aggregation, which combines on the map side, so a key held by a third of all
rows shrinks to one row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _null_safe(left: str, right: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def distinct_by(df: DataFrame, key: str, order: str, drop_null_keys: bool = False) -> DataFrame:
    """One row per key, the one with the lowest ``order``. Null keys count as
    equal to each other, or are dropped first."""
    if drop_null_keys:
        df = df.where(F.col(key).isNotNull())
    if key == order:
        return df.dropDuplicates([key])
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("__key")).agg(
        F.min_by(row, F.struct(F.col(order))).alias("__row")).select("__row.*")


def anti_join(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``; null equals null. The right
    side is made distinct, so a hot key there costs nothing."""
    keys = other.select(*columns).distinct()
    return df.alias("l").join(keys.alias("r"), _null_safe("l", "r", columns), "left_anti")


def subtract_by_id(df: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    return anti_join(df, other, [id_col])


def difference_by_key(df: DataFrame, other: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` made distinct by key, without the keys of ``other``. The cheap
    anti join goes first, so that fewer rows reach the aggregation."""
    return distinct_by(anti_join(df, other, [key]), key, order)


def difference_unique(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once in ``df`` and not in ``other``; every copy of
    a repeated key goes."""
    rest = anti_join(df, other, [key])
    grouped = rest.groupBy(F.col(key).alias("__key")).agg(
        F.first(F.struct(*rest.columns)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    return grouped.where(F.col("__n") == 1).select("__row.*")


def label_union(parts: Sequence[tuple[DataFrame, int]], label: str = "LABEL") -> DataFrame:
    """Union by name with a constant label per part."""
    out = None
    for df, value in parts:
        tagged = df.withColumn(label, F.lit(value))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def except_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.subtract(other)


def intersect_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.intersect(other)


def generation_report(df: DataFrame, text_col: str, valid: Column, approximate: bool = False) -> DataFrame:
    """Generated rows, distinct valid texts and their ratio."""
    kept = F.when(valid, F.md5(text_col))  # texts stay where they are; 128 bits are counted
    unique = F.approx_count_distinct(kept) if approximate else F.count_distinct(kept)
    return df.agg(F.count(F.lit(1)).alias("n_generated"), unique.alias("n_unique_valid")).withColumn(
        "validity", F.when(F.col("n_generated") > 0, F.col("n_unique_valid") / F.col("n_generated")))
