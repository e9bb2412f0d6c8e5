"""Curation: raw library to a clean, distinct, normalised and indexed one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.barrier import evaluate_once
from lexisieve.operators.cleaning import add_token_pass, keep_valid, normalize_rows, token_filter
from lexisieve.operators.dedup import distinct_by
from lexisieve.operators.index import add_index
from lexisieve.sources.readers import read_items
from lexisieve.sources.files import base_name, input_facts, read_text, write_text
from lexisieve.sources.writers import MARK, already_processed, finished, save_result

#: File of a curated output that names the files it was made of.
INPUT_FACTS = "_INPUTS"


def clean_rows(df: DataFrame, text_col: str = "SMILES", known: Sequence[str] | None = None) -> DataFrame:
    """The stateless part of :func:`curate`, also usable on a stream."""
    normal = normalize_rows(keep_valid(df, text_col, known), text_col)
    return add_token_pass(normal, text_col, known, "__pass").where("__pass").drop("__pass")


def clean_big_library(df: DataFrame, text_col: str = "SMILES", id_col: str = "ID", ring_flag: str | None = None,
                      allowed_flag: str | None = None, property_col: str = "plogP",
                      known: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaning of a very large library: validity, ring flag, structure
    alert flag (both supplied columns), token filter. Returns passing and
    failing rows. Row-wise only, so it needs no shuffle and no chunks."""
    kept = keep_valid(df, text_col, known)
    for flag in (ring_flag, allowed_flag):
        if flag is not None:
            kept = kept.where(F.col(flag))
    passed, failed, _ = token_filter(kept, text_col, id_col, property_col, known)
    return passed, failed


def curate(df: DataFrame, id_col: str = "ID", text_col: str = "SMILES", key: Column | None = None,
           known: Sequence[str] | None = None, dedup_again: bool = False,
           index_col: str | None = None) -> DataFrame:
    """Validity, distinct by key, normalisation, token filter, index.

    ``key`` is the canonical key (md5 of the text by default, so that long text
    is shuffled once); the row with the
    lowest id represents it. Selecting the longest fragment after deduplication
    can make rows equal again; ``dedup_again`` removes them. Row filters are
    pushed below the one shuffle of the distinct step by Catalyst where they
    do not depend on it.
    """
    keyed = evaluate_once(keep_valid(df, text_col, known), __key=F.md5(text_col) if key is None else key)
    one_each = distinct_by(keyed, "__key", id_col, drop_null_keys=True).drop("__key")
    normal = normalize_rows(one_each, text_col)
    passed = add_token_pass(normal, text_col, known, "__pass").where("__pass").drop("__pass")
    if dedup_again:
        passed = distinct_by(passed.withColumn("__key", F.md5(text_col)), "__key", id_col).drop("__key")
    if index_col is not None:
        passed = add_index(passed, [id_col], index_col, unique=True)
    return passed


def curate_file(spark, path: str, out_dir: str, fmt: str = "csv", **options) -> str:
    """Read, curate and save a library file. A finished output of the same input, or an input that
    is already curated, is returned as it is. An unfinished output is redone, and so is the output of an input whose
    files have changed since: their paths, lengths and times lie beside ``_SUCCESS``."""
    if already_processed(path):
        return path
    out = f"{out_dir.rstrip('/')}/{base_name(path)}{MARK}.{fmt}"
    facts, noted = input_facts(spark, path), f"{out}/{INPUT_FACTS}"
    if finished(spark, out) and read_text(spark, noted) == facts:
        return out
    df = read_items(spark, path)
    if "ID" not in df.columns:
        df = add_index(df, ["SMILES"], "ID")
    save_result(curate(df, **options), out, fmt, mode="overwrite")
    write_text(spark, noted, facts)
    return out
