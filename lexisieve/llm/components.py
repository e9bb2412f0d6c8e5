"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.session import materialize


def connected(links: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """``id``, ``component`` (smallest id reachable) of every id that has a link to another.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes:
    a logarithmic number of rounds in practice. Only minima are aggregated, in
    each task first, so the hub of a large group is no hot key; each round's
    edges are written to the shared folder.
    """
    edges = materialize(links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours point to the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            low.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct())
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Count and checksums of distinct edges: equal for equal tables, whatever their order."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.pmod(mixed, F.lit(1 << 31)))).first())
