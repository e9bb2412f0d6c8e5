"""Profiles, comparisons and summaries.

Percentiles are exact and distributed: values are counted first, ordered
globally, and only the rows at the wanted ranks are picked. Spark's own exact
``percentile`` keeps all distinct values of a group in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.functions.tokens import SPECIALS
from lexisieve.operators.index import global_rank, running_sums
from lexisieve.session import small_side


def unpivot(df: DataFrame, values: Sequence[str], ids: Sequence[str] = (), name: str = "descriptor",
            value: str = "value") -> DataFrame:
    """Wide to long in one scan; null values are kept."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return typed.unpivot(list(ids), list(values), name, value)


def unpivot_compare(left: DataFrame, right: DataFrame, columns: Sequence[str],
                    names: tuple[str, str] = ("Real", "AI Design")) -> DataFrame:
    """``value, descriptor, data`` of two tables below each other."""
    parts = [unpivot(df, columns).withColumn("data", F.lit(n)) for df, n in zip((left, right), names)]
    return parts[0].unionByName(parts[1]).select("value", "descriptor", "data")


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float],
                      weight: str | None = None) -> DataFrame:
    """Linearly interpolated percentiles per group, one column per entry; null
    for a group without values."""
    one = F.lit(1) if weight is None else F.col(weight)
    counts = df.groupBy(*groups, value).agg(F.sum(F.when(F.col(value).isNotNull(), one).otherwise(0)).alias("__n"))
    running = running_sums(counts, [*groups, value], {"__end": F.col("__n")}, unique=True)
    bounds = small_side(running.groupBy(*groups).agg(
        F.min(F.col("__end") - F.col("__n")).alias("__base"), F.max("__end").alias("__top")))
    placed = running.join(bounds, list(groups)).withColumns({
        "__end": F.col("__end") - F.col("__base"), "__total": F.col("__top") - F.col("__base")})
    picks = []
    for out, p in probabilities.items():
        position = (F.col("__total") - 1) * F.lit(float(p))
        for mark, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("__end") - F.col("__n") <= rank) & (rank < F.col("__end"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"__{mark}_{out}"))
    picked = placed.groupBy(*groups).agg(F.max("__total").alias("__total"), *picks)
    results = []
    for out, p in probabilities.items():
        position = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo_{out}"), F.col(f"__hi_{out}")
        results.append((low + (high - low) * (position - F.floor(position))).alias(out))
    return picked.select(*groups, *results)


def _moments(value: str) -> list[Column]:
    return [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"), F.max(value).alias("max")]


# The percentiles of the summary table.
SUMMARY_PERCENTILES = {"p5": 0.05, "p50": 0.5, "p95": 0.95}


def describe_columns(df: DataFrame, columns: Sequence[str], decimals: int = 2,
                     approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, min, 5/50/95 % and max per column."""
    long = unpivot(df, columns).where(F.col("value").isNotNull())
    if approximate:
        quantiles = F.percentile_approx("value", list(SUMMARY_PERCENTILES.values()))
        both = long.groupBy("descriptor").agg(*_moments("value"), quantiles.alias("__q")).select(
            "*", *[F.col("__q")[i].alias(n) for i, n in enumerate(SUMMARY_PERCENTILES)])
    else:
        both = long.groupBy("descriptor").agg(*_moments("value")).join(
            exact_percentiles(long, ["descriptor"], "value", SUMMARY_PERCENTILES), "descriptor")
    shown = ["mean", "std", "min", *SUMMARY_PERCENTILES, "max"]
    return both.select("descriptor", "count", *[F.bround(c, decimals).alias(c) for c in shown])


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max of each column, the last one closed;
    empty bins are listed. The broadcast ranges are one row per column."""
    long = unpivot(df, columns).where(F.col("value").isNotNull())
    ranges = long.groupBy("descriptor").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") > F.col("lo"), F.least(
        F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = long.join(F.broadcast(ranges), "descriptor").groupBy("descriptor", number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    frame = ranges.select("descriptor", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, ["descriptor", "bin"], "left").select(
        "descriptor", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n"))


def compare_distributions(long: DataFrame, total: str = "all") -> DataFrame:
    """Moments and quartiles per descriptor and data set, and per descriptor
    over all data sets. Totals reuse the value counts."""
    counted = long.where(F.col("value").isNotNull()).groupBy("descriptor", "data", "value").agg(
        F.count(F.lit(1)).alias("w"))
    both = counted.withColumn("data", F.explode(F.array(F.col("data"), F.lit(total)))).groupBy(
        "descriptor", "data", "value").agg(F.sum("w").alias("w"))
    quartiles = exact_percentiles(both, ["descriptor", "data"], "value",
                                  {"p25": 0.25, "p50": 0.5, "p75": 0.75}, weight="w")
    moments = long.rollup("descriptor", "data").agg(*_moments("value")).where(
        F.col("descriptor").isNotNull()).withColumn("data", F.coalesce("data", F.lit(total)))
    return moments.join(quartiles, ["descriptor", "data"])


def build_vocab(df: DataFrame, tokens_col: str) -> DataFrame:
    """``token, id``: distinct tokens in code point order, then the specials.
    Tokens that look like a special stop the query."""
    token = F.explode(F.array_distinct(tokens_col)).alias("token")
    seen = df.select(token).distinct().withColumn(
        "token", F.when(F.col("token").isin(*SPECIALS), F.raise_error(F.lit("special token in the data")))
        .otherwise(F.col("token"))).withColumn("kind", F.lit(0))
    specials = df.sparkSession.createDataFrame(
        [(s, i + 1) for i, s in enumerate(SPECIALS)], "token string, kind int")
    return global_rank(seen.union(specials), ["kind", "token"], "id", unique=True).select("token", "id")


def property_columns(df: DataFrame, id_col: str = "ID", text_col: str = "SMILES") -> list[str]:
    return [c for c in df.columns if c not in (id_col, text_col)]


def property_matrix(df: DataFrame, id_col: str = "ID", text_col: str = "SMILES",
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Id, text, the properties as one array and their number."""
    names = list(columns) if columns else property_columns(df, id_col, text_col)
    return df.select(id_col, text_col, F.array(*[F.col(c).cast("double") for c in names]).alias("properties"),
                     F.lit(len(names)).alias("property_num"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1, specificity, geometric mean and support per class.
    After the first aggregation only label pairs are left."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("all")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("all")),
    )).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                     F.sum("tp").alias("tp"), F.sum("all").alias("own"))
    total = F.sum("own").over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("total", total)
    tn = F.col("total") - F.col("support") - F.col("predicted") + F.col("tp")
    return per.select(
        "class",
        F.try_divide("tp", "predicted").alias("precision"),
        F.try_divide("tp", "support").alias("recall"),
        F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        F.try_divide(tn, F.col("total") - F.col("support")).alias("specificity"),
        F.sqrt(F.try_divide("tp", "support") * F.try_divide(tn, F.col("total") - F.col("support"))).alias("geo_mean"),
        "support")


MISSING = -1


def conditional_entropy(df: DataFrame, targets: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """H(target | variable) in nats for each pair of binned columns, -1 and
    null being missing. One scan; pairs without data score 0."""
    pairs = [F.struct(F.lit(i).alias("t_no"), F.lit(t).alias("target"), F.lit(j).alias("u_no"),
                      F.lit(u).alias("variable"), F.col(t).cast("long").alias("t"),
                      F.col(u).cast("long").alias("u"))
             for i, t in enumerate(targets) for j, u in enumerate(variables)]
    keys = ["t_no", "target", "u_no", "variable"]
    cells = df.select(F.explode(F.array(*pairs)).alias("c")).select("c.*").groupBy(*keys, "t", "u").agg(
        F.count(F.lit(1)).alias("n"))
    usable = F.col("t").isNotNull() & F.col("u").isNotNull() & (F.col("t") != MISSING) & (F.col("u") != MISSING)
    cells = cells.withColumn("n", F.when(usable, F.col("n")).otherwise(0))
    columns = cells.groupBy(*keys, "u").agg(
        F.sum("n").alias("s"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log("n")).otherwise(0.0)).alias("nlogn"))
    by_pair = columns.groupBy(*keys).agg(
        F.sum("s").alias("total"),
        F.sum(F.when(F.col("s") > 0, F.col("s") * F.log("s") - F.col("nlogn")).otherwise(0.0)).alias("h"))
    return by_pair.select(*keys, F.when(F.col("total") > 0, F.col("h") / F.col("total")).otherwise(0.0).alias("score"))


def entropy_order(scores: DataFrame) -> DataFrame:
    """Each variable at its lowest-entropy target, ascending, placed right and
    left of the target in turn: ``target, member, position`` with the target
    itself at 0. The input has one row per pair of columns."""
    keys = F.struct("score", "t_no")
    chosen = scores.groupBy("u_no", "variable").agg(
        F.min_by(F.struct("t_no", "target", "score"), keys).alias("best")).select("u_no", "variable", "best.*")
    rank = F.row_number().over(Window.partitionBy("t_no").orderBy("score", "u_no"))
    side = F.when(F.col("r") % 2 == 1, F.ceil(F.col("r") / 2)).otherwise(-F.col("r") / 2).cast("int")
    members = chosen.withColumn("r", rank).select(
        "t_no", "target", F.col("variable").alias("member"), side.alias("position"))
    heads = scores.select("t_no", "target").distinct().select(
        "t_no", "target", F.col("target").alias("member"), F.lit(0).alias("position"))
    return members.union(heads).drop("t_no")


def cell_counts(df: DataFrame, cell: str, label: str) -> DataFrame:
    return df.groupBy(cell, label).agg(F.count(F.lit(1)).alias("n"))


def cell_purity(train: DataFrame, rows: DataFrame, cell: str, label: str, positive=1,
                out: str = "score") -> DataFrame:
    """Share of the positive label in the cell of each row; 0 for an unseen
    cell and for a cell with more than two labels."""
    counts = cell_counts(train, cell, label)
    purity = counts.groupBy(cell).agg(
        F.count(F.lit(1)).alias("__labels"),
        F.sum(F.when(F.col(label) == positive, F.col("n")).otherwise(0)).alias("__pos"),
        F.sum("n").alias("__all")
    ).select(cell, F.when(F.col("__labels") <= 2, F.col("__pos") / F.col("__all")).otherwise(0.0).alias(out))
    return rows.join(small_side(purity), cell, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def metric_means(df: DataFrame, metric: str, value: str) -> DataFrame:
    return df.groupBy(F.col(metric).alias("metric")).agg(F.avg(value).alias("mean"))
