"""Mixing sources, batches and exact samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.barrier import evaluate_once
from lexisieve.functions.hashing import MD5_RANGE, seeded, seeded_int, seeded_uniform
from lexisieve.operators.dedup import difference_unique, distinct_by, label_union
from lexisieve.operators.index import global_rank, grouped_rank, top_n
from lexisieve.operators.similarity import remove_known
from lexisieve.session import materialize

# Default shares of the four libraries, and the share of the
# non-family library when there is no family library.
DEFAULT_RATIOS = {"active": 0.5, "molecule": 0.3, "family": 0.1, "non_family": 0.1}
NON_FAMILY_ALONE = 0.2

#: Draws that one copy of a source row serves before it is replicated.
DRAWS_PER_COPY = 10_000


def source_ratios(has_family: bool = True, **ratios: float) -> dict[str, float]:
    out = {**DEFAULT_RATIOS, **ratios}
    if not has_family:
        out["family"], out["non_family"] = 0.0, NON_FAMILY_ALONE
    return {name: p for name, p in out.items() if p != 0}


def epoch_length(sizes: Mapping[str, int], ratios: Mapping[str, float]) -> int:
    """Largest floor(n / p) over the sources, with p as given."""
    return max(int(sizes[s] / ratios[s]) for s in sizes)


def _source_sizes(df: DataFrame, source_col: str, ratios: Mapping[str, float]) -> dict[str, int]:
    rows = df.where(F.col(source_col).isin(*ratios)).groupBy(source_col).count().collect()
    found = {r[0]: r[1] for r in rows if ratios.get(r[0])}
    return {s: found[s] for s in ratios if s in found}


def draw_sources(spark, sizes: Mapping[str, int], ratios: Mapping[str, float], seed: int = 0,
                 source_col: str = "source") -> DataFrame:
    """``draw, source, row``: which row of which source each draw of an epoch
    takes. Draws are independent, so this needs no shuffle."""
    length = epoch_length(sizes, ratios)
    total = sum(ratios[s] for s in sizes)
    names, ends, acc = list(sizes), [], 0.0
    for s in names:
        acc += ratios[s] / total
        ends.append(acc)
    draws = evaluate_once(
        spark.range(length).withColumnRenamed("id", "draw"), __u=seeded_uniform(seed, F.col("draw")))
    pick = F.lit(names[-1])  # the last interval is closed
    size = F.lit(sizes[names[-1]])
    for s, end in reversed(list(zip(names[:-1], ends[:-1]))):
        pick = F.when(F.col("__u") < end, F.lit(s)).otherwise(pick)
        size = F.when(F.col("__u") < end, F.lit(sizes[s])).otherwise(size)
    return draws.select("draw", pick.alias(source_col), F.pmod(F.col("draw"), size.cast("long")).alias("row"))


def mix_sources(df: DataFrame, ratios: Mapping[str, float], source_col: str, id_col: str,
                seed: int = 0) -> DataFrame:
    """One epoch of weighted draws with recycling: ``draw`` and the columns of
    the drawn row. ``df`` holds all sources, told apart by ``source_col``.

    Rows of a short source are drawn very often; they are replicated in
    proportion, and draws spread over the replicas, so no key is hot.
    """
    ratios = {s: p for s, p in ratios.items() if p}
    sizes = _source_sizes(df, source_col, ratios)
    if not sizes:
        raise ValueError("none of the sources has rows")
    draws = draw_sources(df.sparkSession, sizes, ratios, seed, source_col)
    length, total = epoch_length(sizes, ratios), sum(ratios[s] for s in sizes)
    copies = F.lit(1)
    for s, n in sizes.items():
        need = max(1, math.ceil(length * ratios[s] / total / n / DRAWS_PER_COPY))
        copies = F.when(F.col(source_col) == s, F.lit(need)).otherwise(copies)
    indexed = grouped_rank(df.where(F.col(source_col).isin(*sizes)), [source_col], [id_col], "row", unique=True)
    replicated = indexed.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    keyed = draws.withColumn("__copy", F.pmod(F.xxhash64("draw"), copies).cast("int"))
    return keyed.join(replicated, [source_col, "row", "__copy"]).drop("row", "__copy")


def mix_quota(df: DataFrame, ratios: Mapping[str, float], source_col: str, seed: int = 0) -> DataFrame:
    """Epoch length, size and number of draws per source, without drawing rows."""
    ratios = {s: p for s, p in ratios.items() if p}
    sizes = _source_sizes(df, source_col, ratios)
    draws = draw_sources(df.sparkSession, sizes, ratios, seed, source_col)
    counted = draws.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_drawn"))
    frame = df.sparkSession.createDataFrame(
        [(s, n, float(ratios[s]), epoch_length(sizes, ratios)) for s, n in sizes.items()],
        f"{source_col} string, n_rows long, ratio double, epoch_length long")
    return frame.join(counted, source_col, "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0)))


def make_batches(df: DataFrame, id_col: str, size: int, seed: int = 0, batch: str = "batch") -> DataFrame:
    """Shuffled into batches of exactly ``size``; the rest is dropped."""
    ranked = global_rank(df, [seeded(seed, F.col(id_col)), F.col(id_col)], "__idx", unique=True)
    whole = ranked.count() // size * size
    return ranked.where(F.col("__idx") < whole).withColumn(batch, F.floor(F.col("__idx") / size)).drop("__idx")


_BUCKETS = 1 << 16


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int = 0, small: int = 1_000) -> DataFrame:
    """Exactly ``n`` rows without replacement: those with the lowest seeded hash.

    A large sample counts rows per hash range (a bounded table), keeps whole
    ranges with a filter, and orders only the one range that is cut.
    """
    order = [seeded(seed, F.col(id_col)), F.col(id_col)]
    if n <= small:
        return top_n(df, order, n)
    bucket = F.floor(seeded_int(seed, F.col(id_col)) / (MD5_RANGE // _BUCKETS))
    counts = sorted((r[0], r[1]) for r in df.groupBy(bucket.alias("b")).count().collect())
    taken, edge = 0, None
    for b, c in counts:
        if taken + c > n:
            edge = b
            break
        taken += c
    if edge is None:
        return df
    whole = df.where(bucket < edge)
    return whole.unionByName(top_n(df.where(bucket == edge), order, n - taken))


def balanced_training_set(active: DataFrame, decoy: DataFrame, id_col: str, set_col: str,
                          key: str | None = None, ratio: int = 2, seed: int = 0,
                          label: str = "LABEL") -> DataFrame:
    """Distinct actives, and as many decoys that are neither repeated, active
    nor identical to an active: ``ratio`` times as many are sampled first."""
    key = key or id_col
    active = materialize(distinct_by(active, key, id_col))
    n = active.count()
    pool = difference_unique(decoy, active, key)
    sampled = materialize(sample_exact(pool, id_col, n * ratio, seed))
    clean = remove_known(sampled, active, id_col, set_col, threshold="==1")
    cut = top_n(clean, [seeded(seed, F.col(id_col)), F.col(id_col)], n)
    return label_union([(active, 1), (cut, 0)], label)


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, values: Sequence[str],
           mask_suffix: str = "_missing") -> DataFrame:
    """Property values by key, with a 0/1 column for keys that are not found.
    Spark broadcasts the table when its size allows it."""
    small = table.select(F.col(table_key).alias("__key"), *values)
    joined = df.join(small, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({
        f"{v}{mask_suffix}": F.when(F.col("__key").isNull() | F.col(v).isNull(), 1).otherwise(0) for v in values
    }).drop("__key")

