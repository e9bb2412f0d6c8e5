"""Global order without a single partition.

``Window.orderBy`` without ``partitionBy`` sends the whole table to one task.
Here rows are range-partitioned, sorted inside the partitions and numbered by
adding the sizes of the partitions before. Only one number per partition is
collected by the final join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.functions.descriptors import zero_padded
from lexisieve.session import default_partitions, materialize, small_side

_PART, _POS = "__part", "__pos"
_POS_BITS = 33  # monotonically_increasing_id: partition number above, position below


def _columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _range_sorted(df: DataFrame, order: Sequence[Column | str], unique: bool) -> DataFrame:
    """Materialised rows with partition and position in the global order.

    Rows that tie on ``order`` get a content hash, then a row number, as last
    sort keys: a hot tie group is split over partitions, and a retried task
    can only swap identical rows.
    """
    keys = _columns(order)
    extra = []
    if not unique:
        df = df.withColumn("__tie", F.xxhash64(*df.columns)).withColumn(
            "__row", F.monotonically_increasing_id())
        extra = [F.col("__tie"), F.col("__row")]
    n = default_partitions(df.sparkSession)
    placed = (
        df.repartitionByRange(n, *keys, *extra)
        .sortWithinPartitions(*keys, *extra)
        .withColumn("__mono", F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright("__mono", _POS_BITS).cast("int"))
        .withColumn(_POS, F.col("__mono").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop("__mono", "__tie", "__row")
    )
    return materialize(placed)


def _with_offsets(placed: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Join every row with the sums of ``totals`` over the partitions before it.
    The offset table has one row per partition, so its broadcast is bounded."""
    per_part = placed.groupBy(_PART).agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        _PART, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals])
    return placed.join(F.broadcast(offsets), _PART)


def global_rank(df: DataFrame, order: Sequence[Column | str], index: str = "idx",
                start: int = 0, unique: bool = False) -> DataFrame:
    """Add the consecutive number of each row in the given order.

    ``unique=True`` promises that ``order`` has no ties.
    """
    placed = _range_sorted(df, order, unique)
    out = _with_offsets(placed, {"__offset": F.count(F.lit(1))})
    return out.withColumn(index, F.col("__offset") + F.col(_POS) + F.lit(start)).drop(
        _PART, _POS, "__offset")


def running_sums(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column],
                 index: str | None = None, unique: bool = False) -> DataFrame:
    """Add running totals (current row included) in a global order.

    The second pass is partitioned by range partition, which range partitioning
    has already made even.
    """
    names = {f"__value_{i}": n for i, n in enumerate(sums)}
    with_values = df.withColumns({v: sums[n] for v, n in names.items()})
    placed = _range_sorted(with_values, order, unique)
    totals = {f"__before_{v}": F.sum(v) for v in names}
    totals["__offset"] = F.count(F.lit(1))
    inside = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_offsets(placed, totals).withColumns(
        {n: F.sum(v).over(inside) + F.col(f"__before_{v}") for v, n in names.items()})
    if index is not None:
        out = out.withColumn(index, F.col("__offset") + F.col(_POS))
    return out.drop(_PART, _POS, *names, *totals)


def grouped_rank(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str],
                 index: str = "idx", start: int = 0, unique: bool = False,
                 size: str | None = None) -> DataFrame:
    """Consecutive number inside each group, for groups of any size.

    A window partitioned by group would put a hot group in one task; the global
    rank minus the group's smallest rank does not.
    """
    placed = _range_sorted(df, [*groups, *order], unique)
    ranked = _with_offsets(placed, {"__offset": F.count(F.lit(1))}).withColumn(
        "__global", F.col("__offset") + F.col(_POS)).drop(_PART, _POS, "__offset")
    firsts = small_side(ranked.groupBy(*groups).agg(
        F.min("__global").alias("__first"), F.count(F.lit(1)).alias("__size")))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"f.{g}")) for g in groups]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    out = ranked.alias("r").join(firsts.alias("f"), condition).select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("__global") - F.col("__first") + F.lit(start)).alias(index),
        *([F.col("__size").alias(size)] if size else []),
    )
    return out


def add_index(df: DataFrame, order: Sequence[Column | str], out: str = "ID",
              prefix: str | None = None, unique: bool = False) -> DataFrame:
    """Zero-padded consecutive ids as wide as the row count, optionally prefixed."""
    ranked = global_rank(df.drop(out), order, "__idx", unique=unique)
    width = len(str(ranked.count()))
    return ranked.withColumn(out, zero_padded(F.col("__idx"), F.lit(width), prefix)).drop("__idx")


def top_n(df: DataFrame, order: Sequence[Column | str], n: int, heap_limit: int = 1_000) -> DataFrame:
    """First ``n`` rows: a per-task heap for small ``n``, the global rank beyond."""
    if n <= heap_limit:
        return df.orderBy(*_columns(order)).limit(n)
    return global_rank(df, order, "__idx").where(F.col("__idx") < n).drop("__idx")
