"""Hash expressions. The md5 forms are stable across engines and versions; the
xxhash64 forms are several times cheaper and stay inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 16**7, the number of values of :func:`md5_int`.
MD5_RANGE = 1 << 28


def md5_int(text: Column) -> Column:
    """First seven hex digits of md5 as a number in [0, 2**28)."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """md5 of ``seed:col:col``; ordering by it is a repeatable shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def seeded_int(seed: int, *cols: Column) -> Column:
    return md5_int(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def seeded_uniform(seed: int, *cols: Column) -> Column:
    """Repeatable uniform number in [0, 1)."""
    return seeded_int(seed, *cols) / F.lit(float(MD5_RANGE))


def set_key(elements: Column) -> Column:
    """128-bit identity of an array, as hex text. Null for null."""
    return F.when(
        elements.isNotNull(),
        F.concat(
            F.lpad(F.hex(F.xxhash64(elements)), 16, "0"),
            F.lpad(F.hex(F.xxhash64(F.lit(7919), elements)), 16, "0"),
        ),
    )
