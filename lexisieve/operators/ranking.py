"""Ranking and its evaluation, rolling and centred values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.operators.index import global_rank, grouped_rank, running_sums
from lexisieve.session import small_side


def rank_scored(df: DataFrame, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """Consecutive rank from 1. End ``order`` with the id, so that it is total."""
    return global_rank(df, order, rank, start=1, unique=True)


def _ranked_labels(df: DataFrame, score: str, label: str, id_col: str, ascending: bool) -> DataFrame:
    first = F.col("__score").asc() if ascending else F.col("__score").desc()
    slim = df.select(F.col(score).alias("__score"), F.col(label).alias("__label"), F.col(id_col).alias("__id"))
    return global_rank(slim, [first, F.col("__id")], "__rank", start=1, unique=True)


def ranking_auc(df: DataFrame, score: str, label: str, id_col: str, ascending: bool = False) -> DataFrame:
    """ROC AUC and average precision of a ranking.

    The ROC part needs only the rank sum of the actives; the precision part
    ranks the actives among themselves, a second order over a small subset.
    """
    ranked = _ranked_labels(df, score, label, id_col, ascending)
    sizes = ranked.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.when(F.col("__label") == 1, 1).otherwise(0)).alias("p")).first()
    n, p = sizes["n"], sizes["p"] or 0
    actives = global_rank(ranked.where(F.col("__label") == 1).select("__rank"), ["__rank"], "__seen",
                          start=1, unique=True)
    late = F.sum(F.col("__rank") - F.col("__seen"))
    return actives.agg(
        (F.lit(1.0) - F.try_divide(late, F.lit(float(p) * float(n - p)))).alias("auc_roc"),
        F.avg(F.col("__seen") / F.col("__rank")).alias("auc_prc"),
        F.lit(n).alias("n"), F.count(F.lit(1)).alias("n_active"))


# The top fractions of the enrichment report.
ENRICHMENT_FRACTIONS = (0.01, 0.05, 0.1, 0.15)


def enrichment_factor(df: DataFrame, score: str, label: str, id_col: str, ascending: bool = False,
                      fractions: Sequence[float] = ENRICHMENT_FRACTIONS) -> DataFrame:
    """Hit rate in the top fractions over the overall hit rate. The cut is
    rounded half to even, and a cut of zero rows gives null."""
    ranked = _ranked_labels(df, score, label, id_col, ascending)
    active = F.col("__label") == 1
    n, p = F.count(F.lit(1)), F.count(F.when(active, 1))
    total = ranked.count()
    tops = {x: int(round(total * x)) for x in fractions}
    hits = [F.count(F.when(active & (F.col("__rank") <= t), 1)) for t in tops.values()]
    one = ranked.agg(n.alias("n"), p.alias("p"), *[h.alias(f"h{i}") for i, h in enumerate(hits)])
    rows = F.array(*[F.struct(F.lit(x).alias("fraction"), F.lit(t).alias("top"), F.col(f"h{i}").alias("hits"))
                     for i, (x, t) in enumerate(tops.items())])
    return one.select("n", "p", F.explode(rows).alias("r")).select(
        "r.fraction", "r.top", "r.hits",
        (F.try_divide(F.col("r.hits"), F.col("r.top")) * F.try_divide(F.col("n"), F.col("p"))).alias("ef"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """``fpr, tpr, threshold`` at every distinct score, from the highest down,
    after a first point (0, 0) without threshold."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    running = running_sums(counts, [F.col("threshold").desc()], {"tp": F.col("p"), "fp": F.col("q")}, unique=True)
    sizes = running.agg(F.sum("p").alias("P"), F.sum("q").alias("Q")).first()
    points = running.select(
        F.try_divide("fp", F.lit(sizes["Q"])).alias("fpr"), F.try_divide("tp", F.lit(sizes["P"])).alias("tpr"),
        F.col("threshold").cast("double").alias("threshold"))
    start = df.sparkSession.createDataFrame([(0.0, 0.0, None)], "fpr double, tpr double, threshold double")
    return start.union(points)


def missing_mask(df: DataFrame, properties: Sequence[str], suffix: str = "_missing") -> DataFrame:
    """Each property with 0 for missing, and a 0/1 mask column per property."""
    return df.withColumns({
        **{f"{p}{suffix}": F.when(F.col(p).isNull(), 1).otherwise(0) for p in properties},
        **{p: F.coalesce(F.col(p), F.lit(0)) for p in properties}})


def rolling_mean(df: DataFrame, group: str, order: Sequence[str], value: str, n: int = 1000,
                 out: str = "rolling_mean", chunk: int = 100_000) -> DataFrame:
    """Mean of the last ``n`` values per group.

    A group of any size is cut into chunks, each with the ``n`` - 1 rows before
    it, so a hot group is spread over many windows.
    """
    chunk = max(chunk, n)
    placed = grouped_rank(df, [group], list(order), "__pos").withColumn(
        "__own", F.floor(F.col("__pos") / chunk))
    late = F.col("__pos") % chunk >= chunk - (n - 1)
    copies = F.when(late, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array(F.col("__own")))
    window = Window.partitionBy(group, "__chunk").orderBy("__pos").rowsBetween(-(n - 1), 0)
    return (
        placed.withColumn("__chunk", F.explode(copies))
        .withColumn(out, F.avg(value).over(window))
        .where(F.col("__chunk") == F.col("__own")).drop("__pos", "__own", "__chunk")
    )


def centered(df: DataFrame, batch: str, value: str, out: str = "centered") -> DataFrame:
    """Value minus the mean of its batch. The mean is aggregated and joined, so
    a hot batch is not gathered in one window."""
    means = small_side(df.groupBy(batch).agg(F.avg(value).alias("__mean")))
    return df.join(means, batch).withColumn(out, F.col(value) - F.col("__mean")).drop("__mean")


def batch_means(df: DataFrame, batch: str, value: str, decimals: int = 4, out: str = "mean_reward") -> DataFrame:
    return df.groupBy(batch).agg(F.bround(F.avg(value), decimals).alias(out))


def collate(df: DataFrame, batch: str, ids_col: str, id_col: str, pad_id: int) -> DataFrame:
    """Rows of a batch by length, longest first, padded to the longest of the
    batch. The window spans one batch, whose size the batching fixes."""
    in_batch = Window.partitionBy(batch)
    sized = df.withColumn("length", F.size(ids_col)).withColumn("__longest", F.max("length").over(in_batch))
    return sized.withColumn(
        "position", F.row_number().over(in_batch.orderBy(F.desc("length"), F.col(id_col)))
    ).withColumn(
        ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), F.col("__longest") - F.col("length")))
    ).drop("__longest")
