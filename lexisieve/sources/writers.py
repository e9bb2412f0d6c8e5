"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.sources.files import exists

#: Columns that only serve a computation and are not saved.
HELPER_COLUMNS = ("tokens", "bits", "grams", "atomic_scaffold_bits", "graph_scaffold_bits")

CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

MARK = "_preprocess"


def without_helpers(df: DataFrame, helpers=HELPER_COLUMNS) -> DataFrame:
    return df.drop(*helpers)


def save_result(df: DataFrame, path: str, fmt: str = "csv", helpers=HELPER_COLUMNS,
                mode: str = "errorifexists", max_records: int | None = None, line_escapes: bool = False) -> str:
    """Write without helper columns; ``max_records`` splits into files of a fixed size.

    CSV values keep their line ends inside quotes, or with ``line_escapes``
    written as backslash and letter, so that files stay one row per line.
    """
    kept = without_helpers(df, helpers)
    if line_escapes:
        kept = kept.withColumns({f.name: escape_lines(F.col(f"`{f.name}`")) for f in kept.schema.fields
                                 if f.dataType.typeName() == "string"})
    writer = kept.write.mode(mode)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)
    return path


def escape_lines(column: Column) -> Column:
    """Line ends and backslashes as a backslash and a letter or backslash."""
    doubled = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def finished(spark, path: str) -> bool:
    """Whether an output folder was committed. What a broken run left is not."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def save_once(df: DataFrame, path: str, fmt: str = "csv", **options) -> bool:
    """Write unless a finished output exists; tells whether it wrote. An unfinished one is replaced."""
    if finished(df.sparkSession, path):
        return False
    save_result(df, path, fmt, mode="overwrite", **options)
    return True


def already_processed(path: str) -> bool:
    return MARK in path


def convert_delimited(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("errorifexists").options(**CSV_OPTIONS).option("sep", sep).csv(path)
    return path


def save_snapshots(tagged: DataFrame, path: str, stage_col: str = "dropped_at") -> str:
    """One folder per filter stage from a single write; the rows alive after a
    stage are the union of the later folders."""
    tagged.withColumn(stage_col, F.coalesce(stage_col, F.lit("kept"))).write.mode(
        "errorifexists").partitionBy(stage_col).parquet(path)
    return path


def with_file_number(df: DataFrame, index_col: str, rows_per_file: int, out: str = "numfile") -> DataFrame:
    """File number of each row by its global index."""
    return df.withColumn(out, F.floor(F.col(index_col) / rows_per_file))
