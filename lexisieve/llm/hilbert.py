"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised, the cell's place on the Hilbert curve
is computed, and the rows in curve order are cut into runs of equal count.
Rows of a shard therefore lie close in every dimension, and file statistics
prune on each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.operators.index import global_rank
from lexisieve.session import materialize


def _curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and following state for (state, cell), by the rule of Hamilton's
    compact Hilbert indices. A state is the entry corner times ``dims`` plus the direction."""
    size = 1 << dims
    turn = lambda v, k: ((v << k % dims) | (v >> (dims - k % dims))) & (size - 1)
    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    digits, following = [], []
    for state in range(size * dims):
        corner, direction = divmod(state, dims)
        for cell in range(size):
            w = rank[turn(cell ^ corner, dims - (direction + 1) % dims)]
            entry = gray[2 * ((w - 1) // 2)] if w else 0
            odd = (w - 1 if w % 2 == 0 else w) if w else 0
            step = (~odd & (odd + 1)).bit_length() - 1  # trailing ones
            digits.append(w)
            following.append((corner ^ turn(entry, direction + 1)) * dims + (direction + step % dims + 1) % dims)
    return digits, following


def hilbert_index(coordinates: Sequence[Column], bits: int) -> Column:
    """Place on the curve of the cell with these non-negative coordinates below ``2**bits``."""
    dims = len(coordinates)
    digits, following = (F.lit(t) for t in _curve_tables(dims))
    levels = F.array(*[
        sum((F.shiftright(c.cast("int"), level).bitwiseAND(1) * (1 << d) for d, c in enumerate(coordinates)), F.lit(0))
        for level in range(bits - 1, -1, -1)])

    def descend(state: Column, cell: Column) -> Column:
        at = state["s"] * (1 << dims) + cell
        return F.struct(F.get(following, at).alias("s"),
                        (state["h"] * (1 << dims) + F.get(digits, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(levels, start, descend, lambda state: state["h"])


def category(column: Column, bits: int) -> Column:
    """A text column as a coordinate: equal values share it; null is 0."""
    return F.coalesce(F.crc32(column.cast("string")) % (1 << bits), F.lit(0)).cast("int")


def magnitude(column: Column, bits: int) -> Column:
    """A non-negative number on a half-octave scale; null counts as 0."""
    return F.least(F.floor(2 * F.log2(F.greatest(F.coalesce(column, F.lit(0)), F.lit(0)) + 1)),
                   F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 5, id_col: str = "doc_id", text_col: str = "text",
                   categories: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``curve``, ``shard`` and ``slot``.

    Law: rows. The counts of any two shards differ by one at most; shards hold
    consecutive runs of (curve, text checksum, id), so equal texts with equal
    metadata lie side by side. A null text counts as an empty one; null
    metadata is a value of its own; repeated rows each get a slot; other
    columns are ignored; an empty table gives no rows.

    The text is read once, into a narrow table; only that is ordered, by range
    partitioning, so no value of any column can fill a task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    curve = hilbert_index([magnitude(size, bits), *[category(F.col(c), bits) for c in categories]], bits)
    narrow = materialize(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"),
                                     curve.alias("curve")))
    total = narrow.count()
    ranked = global_rank(narrow, ["curve", "text_crc32", "id"], "place")
    # exact in integers: the first place of shard s is ceil(s * total / shards)
    shard = F.expr(f"cast((place * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).select(
        F.col("id").alias(id_col), "size", "text_crc32", "curve", "shard", (F.col("place") - first).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, each in slot order."""
    keys = placed.select(id_col, F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    (docs.join(keys, id_col).repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
     .withColumnRenamed("__shard", "shard").drop("__slot").write.partitionBy("shard").parquet(path))
