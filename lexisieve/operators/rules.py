"""Rule filters: conjunctions of ranges over descriptor columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The named rules, as a rule file writes them.
RULES = {
    "RO5": "200<=MW & MW<=500 & -2<=logP & logP<=5 & HBD<=5 & HBA<=10 & TPSA<=150 & NRB<=10 & MCF==True",
    "kinase": "250<=MW & MW<=600 & -2<=logP & logP<=6 & HBD<=5 & HBA<=10 & TPSA<=200 & NRB<=10 & MCF==True",
    "TPP": "300<=MW & MW<=650 & -2<=logP & logP<=6 & HBD<=5 & HBA<=10 & TPSA<170 & NRB<=10 & MCF==True",
    "PPK1": "350<=MW & MW<=650 & -2<=logP & logP<=6 & HBD<=5 & HBA<=10 & TPSA<150 & NRB<10 & MCF==True",
    "PPI": "204.3<MW & MW<928.6 & 0.8<logP & logP<8.8 & 2<=HBA & HBA<=11 & 2<=rings & rings<=7 & MCF==True",
    "NA": "266<=MW & MW<=670 & -2.22<=logP & logP<=4.87 & HBD<=6 & HBA<=14 & TPSA<=231.7 & NRB<=14 & MCF==True",
    "Cov": "1.49<=logP & logP<=6 & 400<=MW & MW<=800 & 1<= HBD & HBD<=10 & 2<= HBA & HBA<=10 & 80 <= TPSA & TPSA<=210",
}

# The descriptor columns, those rounded before a rule is applied
# and the number of decimals.
DESCRIPTORS = ("MW", "logP", "HBA", "HBD", "TPSA", "NRB", "MCF", "SA", "QED", "rings")
ROUNDED = ("MW", "logP", "TPSA", "SA", "QED")
DECIMALS = 3

_TOKEN = re.compile(r"\s*(?:(<=|>=|==|!=|<|>|[&|~()])|([A-Za-z_]\w*)|([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?))")
_COMPARES = frozenset(("<=", ">=", "==", "!=", "<", ">"))
_WORD_FORMS = {"and": "&", "or": "|", "not": "~"}


def _rule_tokens(rule: str) -> list[str]:
    out, at = [], 0
    while rule[at:].strip():
        found = _TOKEN.match(rule, at)
        if not found:
            raise ValueError(f"cannot be read in a rule: {rule[at:].strip()!r}")
        word = found[1] or found[2] or found[3]
        out.append(_WORD_FORMS.get(word, word))
        at = found.end()
    return out


def rule_to_sql(rule: str) -> str:
    """Rule text to a bracketed Spark SQL predicate.

    A rule combines comparisons of names, numbers and booleans, chained ones
    too, by ``~``, ``&`` and ``|`` (or not, and, or) and nested brackets, in
    that order of binding. Anything else is refused.
    """
    tokens = _rule_tokens(rule)

    def either(at: int) -> tuple[str, int]:
        return _joined(at, both, "|", "OR")

    def both(at: int) -> tuple[str, int]:
        return _joined(at, single, "&", "AND")

    def _joined(at: int, part, sign: str, word: str) -> tuple[str, int]:
        sql, at = part(at)
        while at < len(tokens) and tokens[at] == sign:
            right, at = part(at + 1)
            sql = f"({sql} {word} {right})"
        return sql, at

    def single(at: int) -> tuple[str, int]:
        if at < len(tokens) and tokens[at] == "~":
            sql, at = single(at + 1)
            return f"(NOT {sql})", at
        if at < len(tokens) and tokens[at] == "(":
            sql, at = either(at + 1)
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"a bracket is not closed in the rule: {rule!r}")
            return sql, at + 1
        return comparison(at)

    def comparison(at: int) -> tuple[str, int]:
        sides, signs = [], []
        while True:
            if at >= len(tokens) or not re.match(r"[\w.+-]", tokens[at]):
                raise ValueError(f"not a comparison in the rule: {rule!r}")
            sides.append(_term(tokens[at]))
            at += 1
            if at >= len(tokens) or tokens[at] not in _COMPARES:
                break
            signs.append(tokens[at])
            at += 1
        if not signs:
            raise ValueError(f"not a comparison in the rule: {rule!r}")
        links = [f"{a} {sign} {b}" for a, sign, b in zip(sides, signs, sides[1:])]
        return "(" + " AND ".join(links) + ")", at

    sql, at = either(0)
    if at != len(tokens):
        raise ValueError(f"left over in the rule: {' '.join(tokens[at:])!r}")
    return sql


def _term(word: str) -> str:
    if word.lower() in ("true", "false"):
        return word.lower()
    return f"`{word}`" if re.match(r"[A-Za-z_]", word) else word


def read_rule(spark, path: str) -> str:
    """The trimmed first line of a rule file on any Hadoop file system."""
    from lexisieve.sources.files import first_line

    return first_line(spark, path).strip()


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN would pass ``>=`` tests in Spark, so it becomes null first."""
    names = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    if columns is not None:
        names &= set(columns)
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns
    ])


def drop_invalid(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in ``subset`` (any column by default)."""
    return nan_to_null(df, subset).na.drop(subset=subset)


def to_number(column: Column) -> Column:
    """Text to double; unreadable text becomes null and not an error."""
    return column.try_cast("double")


def rounded(df: DataFrame, columns: list[str], decimals: int = DECIMALS) -> DataFrame:
    """Half-even rounding, which decides rows on the border of a rule."""
    return df.withColumns({c: F.bround(F.col(c), decimals) for c in columns if c in df.columns})


def rule_filter(df: DataFrame, rule: str, round_columns: list[str] | None = None,
                flag: str | None = None, required: list[str] | None = None) -> DataFrame:
    """Optional boolean pre-filter, drop incomplete rows, round, apply the rule."""
    if flag is not None:
        df = df.where(F.col(flag))
    needed = required if required is not None else [c for c in DESCRIPTORS if c in df.columns]
    df = drop_invalid(df, needed) if needed else nan_to_null(df)
    df = rounded(df, list(ROUNDED) if round_columns is None else round_columns)
    return df.where(F.expr(rule_to_sql(rule)))


def rule_profile(df: DataFrame, rules: dict[str, str], keep: list[str]) -> DataFrame:
    """Every rule as a boolean column, and the number of rules passed."""
    flags = {name: F.coalesce(F.expr(rule_to_sql(rule)), F.lit(False)) for name, rule in rules.items()}
    out = df.select(*keep, *[c.alias(n) for n, c in flags.items()])
    total = sum((F.col(n).cast("int") for n in flags), F.lit(0))
    return out.withColumn("n_passed", total)


def relabel(column: Column, mapping: dict[str, int]) -> Column:
    """Remap labels; a label outside the mapping stops the query."""
    out = None
    for old, new in mapping.items():
        out = F.when(column == old, F.lit(new)) if out is None else out.when(column == old, F.lit(new))
    return out.otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(column, F.lit("null")))).cast("int")
    )
