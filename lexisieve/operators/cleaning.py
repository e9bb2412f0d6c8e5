"""Row cleaning: validity, normalisation and the token filter as table steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.barrier import evaluate_once
from lexisieve.functions.descriptors import invalid_reason, normalize
from lexisieve.functions.tokens import TOKEN_IDS, all_known, atom_tokens


def add_tokens(df: DataFrame, text_col: str, out: str = "tokens",
               tokenizer: Callable[[Column], Column] = atom_tokens) -> DataFrame:
    return df.withColumn(out, tokenizer(F.col(text_col)))


def add_validity(df: DataFrame, text_col: str, tokens_col: str = "tokens",
                 known: Sequence[str] | None = None) -> DataFrame:
    """Columns ``valid`` and ``invalid_reason``."""
    return df.withColumn(
        "invalid_reason", invalid_reason(F.col(text_col), F.col(tokens_col), known)
    ).withColumn("valid", F.col("invalid_reason").isNull())


def keep_valid(df: DataFrame, text_col: str, known: Sequence[str] | None = None) -> DataFrame:
    staged = evaluate_once(df, __tokens=atom_tokens(F.col(text_col)))
    checked = evaluate_once(staged, __reason=invalid_reason(F.col(text_col), F.col("__tokens"), known))
    return checked.where(F.col("__reason").isNull()).drop("__tokens", "__reason")


def normalize_rows(df: DataFrame, text_col: str, **options) -> DataFrame:
    """Normalised text; rows that cannot be normalised are dropped."""
    normal = evaluate_once(df, __normal=normalize(F.col(text_col), **options))
    kept = normal.where(F.col("__normal").isNotNull())
    return kept.select(*[F.col("__normal").alias(c) if c == text_col else F.col(c) for c in df.columns])


def add_token_pass(df: DataFrame, text_col: str, known: Sequence[str] | None = None,
                   out: str = "pass") -> DataFrame:
    """Whether all tokens are in the vocabulary. Long text passes: cutting
    happens after the lookup."""
    staged = evaluate_once(df, __tokens=atom_tokens(F.col(text_col)))
    return evaluate_once(staged, **{out: all_known(F.col("__tokens"), known)}).drop("__tokens")


def token_filter(df: DataFrame, text_col: str, id_col: str = "ID", property_col: str | None = "plogP",
                 known: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passing rows, failing rows (id, text, property) and a one-row count of
    the failing ones."""
    checked = add_token_pass(df, text_col, known, "__pass")
    passed = checked.where("__pass").drop("__pass")
    failed = checked.where(~F.col("__pass")).select(
        id_col, text_col, *([property_col] if property_col else []))
    n_failed = checked.agg(F.count(F.when(~F.col("__pass"), 1)).alias("n_fail"))
    return passed, failed, n_failed


def vocabulary(ids: dict[str, int] = TOKEN_IDS) -> list[str]:
    return list(ids)
