"""Screening: a rule, then exact and near matches with a known set, then two
containment tests, in order of cost."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.operators.containment import containment_pairs
from lexisieve.operators.rules import nan_to_null, rule_to_sql, rounded
from lexisieve.operators.similarity import known_set_keys, with_set_key
from lexisieve.session import concurrently, materialize, small_side

# The stages, in order.
STAGES = ("property", "hard", "soft", "atom", "graph")


def tag_cascade(df: DataFrame, known: DataFrame, fragments: DataFrame, rule: str, id_col: str,
                set_col: str, scaffold_col: str, generic_col: str,
                round_columns: list[str] | None = None, required: list[str] | None = None,
                soft: str = ">0.85") -> DataFrame:
    """``df`` with ``dropped_at``: the stage that removed the row, null for rows
    that survive all five.

    ``df`` is read once per stage; it should be a written table. The stages behind the rule look at all rows that pass it, side by side, each
    reading only the columns it needs; a row is tagged with the first stage that it fails, in one aggregation.
    """
    needed = required or []
    features = nan_to_null(df)
    features = rounded(features, round_columns or [])
    complete = reduce(lambda a, c: a & F.col(c).isNotNull(), needed, F.lit(True))
    features = features.withColumn("__ok", complete & F.coalesce(F.expr(rule_to_sql(rule)), F.lit(False)))
    alive = features.where("__ok")

    def near(threshold: str) -> DataFrame:
        keys = known_set_keys(alive, known, id_col, set_col, threshold=threshold)
        return with_set_key(alive, set_col).join(small_side(keys), "__set", "left_semi").select(id_col)

    def containing(column: str) -> DataFrame:
        return containment_pairs(alive, fragments, id_col, column).select(F.col("id").alias(id_col)).distinct()

    tests = {"hard": partial(near, "==1"), "soft": partial(near, soft),
             "atom": partial(containing, scaffold_col), "graph": partial(containing, generic_col)}
    hits = concurrently([lambda s=stage, t=test: materialize(t().select(id_col, F.lit(STAGES.index(s)).alias("__stage")))
                         for stage, test in tests.items()], len(tests))
    first = reduce(DataFrame.unionByName, hits).groupBy(id_col).agg(F.min("__stage").alias("__stage"))
    tagged = features.join(small_side(first), id_col, "left")
    names = F.array(*map(F.lit, STAGES))
    return tagged.withColumn("dropped_at", F.when(~F.col("__ok"), STAGES[0]).otherwise(F.get(names, F.col("__stage")))).drop(
        "__ok", "__stage")


def rows_after(tagged: DataFrame, stage: str = "soft") -> DataFrame:
    """Rows alive after a stage."""
    later = STAGES[STAGES.index(stage) + 1:]
    gone = F.col("dropped_at")
    return tagged.where(gone.isNull() | gone.isin(*later)) if later else tagged.where(gone.isNull())


def funnel(tagged: DataFrame) -> DataFrame:
    """Rows dropped at and alive after each stage. One pass; five result rows."""
    spark = tagged.sparkSession
    order = F.array(*[F.lit(s) for s in STAGES])
    counts = tagged.groupBy("dropped_at").agg(F.count(F.lit(1)).alias("n"))
    stages = spark.createDataFrame([(s,) for s in STAGES], "stage string")
    joined = stages.join(counts, F.col("stage") == F.col("dropped_at"), "left").select(
        "stage", F.coalesce("n", F.lit(0)).alias("n_dropped"))
    survivors = counts.where(F.col("dropped_at").isNull()).select(
        F.lit(None).cast("string").alias("stage"), F.col("n").alias("n_dropped"))
    position = F.coalesce(F.array_position(order, F.col("stage")), F.lit(len(STAGES) + 1))
    after = Window.orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        joined.union(survivors)
        .withColumn("n_remaining", F.coalesce(F.sum("n_dropped").over(after), F.lit(0)))
        .where(F.col("stage").isNotNull())
    )
