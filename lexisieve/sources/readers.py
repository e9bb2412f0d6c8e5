"""Readers. Columns are named by the header and read as text; callers declare
types, nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.sources.files import file_format, glob



def unescape_lines(column: Column) -> Column:
    """Undo :func:`lexisieve.sources.writers.escape_lines`."""
    parts = F.split(column, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))), "\\")


ITEM_SCHEMA = T.StructType([T.StructField("ID", T.StringType()), T.StructField("SMILES", T.StringType())])


def read_delimited(spark: SparkSession, path, sep: str = ",", schema: T.StructType | None = None,
                   columns: list[str] | None = None, multi_line: bool = True,
                   line_escapes: bool = False) -> DataFrame:
    """Delimited text with a header; ``.gz`` is unpacked by Spark. ``schema``
    casts the named columns, unreadable values becoming null.

    Quoted values may hold line ends; such a file is read by one task. Files
    known to have none can be split with ``multi_line=False``, and so can files
    written with ``line_escapes=True``, whose values are given back unchanged.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    df = reader.option("multiLine", multi_line and not line_escapes).option("lineSep", "\n").csv(path)
    if not line_escapes:  # the last value of a line that ends in a carriage return and a line feed
        last = df.columns[-1]
        named = last.removesuffix("\r")
        df = df.withColumn(last, F.regexp_replace(f"`{last}`", "\r$", "")).withColumnRenamed(last, named) if last != named else df
    else:
        df = df.select(*[unescape_lines(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if schema is not None:
        return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return df.select(*columns) if columns else df


def read_items(spark: SparkSession, path: str, id_col: str = "ID", text_col: str = "SMILES",
               default_property: float | None = 1.1, property_col: str = "plogP") -> DataFrame:
    """``ID``, text and the conditioning property by file format. A supplied
    property is kept; a missing one is the constant. Without an id column the
    caller adds one with :func:`lexisieve.operators.index.add_index`."""
    kind = file_format(path)
    if kind == "csv":
        df = read_delimited(spark, path)
    elif kind in ("tsv", "txt"):
        df = read_delimited(spark, path, sep="\t")
    elif kind == "smi":
        df = read_notation_lines(spark, path, id_col, text_col)
    elif kind == "sdf":
        df = read_structures(spark, path, id_col, text_col).select(id_col, text_col)
    else:
        raise ValueError(f"no reader for {path!r}")
    ids = [id_col] if id_col in df.columns else []
    out = df.select(*ids, text_col, *([property_col] if property_col in df.columns else []))
    if default_property is None:
        return out
    if property_col in df.columns:
        return out.withColumn(property_col, F.col(property_col).try_cast("double"))
    return out.withColumn(property_col, F.lit(default_property))


def read_big_library(spark: SparkSession, path) -> DataFrame:
    """The tab-separated large library with its columns renamed."""
    schema = T.StructType([
        T.StructField("zinc_id", T.StringType()), T.StructField("smiles", T.StringType()),
        T.StructField("mwt", T.DoubleType()), T.StructField("logp", T.DoubleType())])
    df = read_delimited(spark, path, sep="\t", schema=schema)
    return df.select(F.col("zinc_id").alias("ID"), F.col("smiles").alias("SMILES"),
                     F.col("mwt").alias("MW"), F.col("logp").alias("logP"), F.lit(1.1).alias("plogP"))


def read_merged(spark: SparkSession, pattern: str, sep: str = ";") -> DataFrame:
    """All files of a glob as one table. Files are read together per distinct
    header, and columns a file lacks are null. The headers are the first lines
    of all files, read in one job."""
    if not glob(spark, pattern):
        raise FileNotFoundError(pattern)
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"),
                                            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    firsts = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    by_header: dict[str, list[str]] = {}
    for row in firsts.collect():
        by_header.setdefault(row["header"], []).append(row["path"])
    out = None
    for paths in by_header.values():
        part = read_delimited(spark, paths, sep=sep)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_notation_lines(spark: SparkSession, path: str, id_col: str = "ID",
                        text_col: str = "SMILES") -> DataFrame:
    """Lines of ``notation id``, separated by blanks or tabs."""
    parts = F.split(F.trim("value"), r"[ \t]+", 2)
    return (
        spark.read.text(path).where(F.length(F.trim("value")) > 0)
        .select(F.get(parts, F.lit(1)).alias(id_col), F.get(parts, F.lit(0)).alias(text_col))
    )


def read_structures(spark: SparkSession, path, id_col: str = "ID", text_col: str = "SMILES",
                    text_tag: str = "SMILES", id_tag: str | None = None,
                    record_end: str = "\n$$$$") -> DataFrame:
    """Multi-record structure files, one row per record: title, counts line and
    the data items as a map. The notation has to be one of the items.

    Lines may end with or without a carriage return, in one file too. Records
    are cut at the line ``$$$$``; what is left of that line's end is removed.
    """
    record = F.regexp_replace(F.regexp_replace("value", "^[ \t]*\r?\n", ""), "\r(?=\n|$)", "")
    lines = F.split("record", "\n")
    keys = F.regexp_extract_all("record", F.lit(r"(?:^|\n)>[^\n]*<([^>\n]+)>[^\n]*\n((?:[^\n]+\n?)*)"), F.lit(1))
    values = F.regexp_extract_all("record", F.lit(r"(?:^|\n)>[^\n]*<([^>\n]+)>[^\n]*\n((?:[^\n]+\n?)*)"), F.lit(2))
    entries = F.zip_with("keys", "values", lambda k, v: F.struct(k.alias("key"), F.rtrim(
        F.regexp_replace(v, "\n+$", "")).alias("value")))
    firsts = F.filter("entries", lambda e, i: F.array_position(F.col("keys"), e["key"]) == i + 1)
    return (
        spark.read.option("lineSep", record_end).text(path)
        .select(record.alias("record")).where(F.length(F.trim("record")) > 0)
        .select("record", F.trim(F.get(lines, F.lit(0))).alias("title"),
                F.get(lines, F.lit(3)).alias("counts"), keys.alias("keys"), values.alias("values"))
        .withColumn("entries", entries)
        .withColumn("items", F.map_from_entries(firsts))
        .select(
            (F.coalesce(F.try_element_at("items", F.lit(id_tag)), F.col("title")) if id_tag
             else F.col("title")).alias(id_col),
            F.try_element_at("items", F.lit(text_tag)).alias(text_col), "title", "counts", "items")
    )
