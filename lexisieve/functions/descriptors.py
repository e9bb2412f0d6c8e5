"""Descriptors, validity and normalisation of line notation, as expressions.

Validity here is lexical (known tokens, balanced brackets, closed rings). It is
weaker than a chemistry parser, which can be plugged in with
:func:`lexisieve.operators.apply.map_partitions`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisieve.functions.tokens import TOKEN_IDS, TWO_LETTER_ATOMS

# Tokens that stand for an atom, by element.
CARBON_TOKENS = ("C", "c")
HETERO_TOKENS = (
    "N", "n", "O", "o", "S", "s", "P", "p", "F", "I", "B", "K", *TWO_LETTER_ATOMS,
)
ATOM_TOKENS = CARBON_TOKENS + HETERO_TOKENS
BOND_TOKENS = ("-", "=", "#", "/", "\\", ":")

_RING_LABEL = "^(%[0-9][0-9]|[1-9])$"


def _balanced(tokens: Column, opening: str, closing: str) -> Column:
    """Running depth never below zero and zero at the end."""
    depth = F.aggregate(
        tokens,
        F.lit(0),
        lambda acc, t: F.when(acc < 0, acc)
        .when(t == opening, acc + 1)
        .when(t == closing, acc - 1)
        .otherwise(acc),
    )
    none = ~F.array_contains(tokens, opening) & ~F.array_contains(tokens, closing)
    return F.when(none, True).otherwise(depth == 0)


def ring_labels(text: Column) -> Column:
    """Ring-closure labels outside square brackets, as tokens."""
    outside = F.regexp_replace(text, r"\[[^\]]*\]", "*")
    return F.regexp_extract_all(outside, F.lit("(%[0-9][0-9]|[1-9])"), F.lit(1))


def rings_closed(text: Column) -> Column:
    """Every ring label occurs an even number of times: a running set in which
    a label is added on its first and removed on its second sight ends empty."""
    open_rings = F.aggregate(
        ring_labels(text),
        F.array().cast("array<string>"),
        lambda acc, t: F.when(F.array_contains(acc, t), F.array_remove(acc, t))
        .otherwise(F.array_append(acc, t)),
    )
    return F.size(open_rings) == 0


def invalid_reason(text: Column, tokens: Column, known: Sequence[str] | None = None) -> Column:
    """Null for valid text, else the first failing test."""
    words = list(TOKEN_IDS) + [".", "0"] if known is None else list(known)
    strange = F.filter(
        F.array_except(tokens, F.array(*[F.lit(w) for w in words])), lambda t: ~t.rlike(_RING_LABEL))
    return (
        F.when(text.isNull(), "missing")
        .when(F.length(text) == 0, "empty")
        .when(F.size(strange) > 0, "unknown token")
        .when(~_balanced(tokens, "(", ")"), "parenthesis")
        .when(~_balanced(tokens, "[", "]"), "bracket")
        .when(~rings_closed(text), "open ring")
    )


def strip_isotopes(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[0-9]+", "[")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def longest_part(text: Column, separator: str = "[.]") -> Column:
    """The longest part, the first one on ties."""
    ranked = F.transform(
        F.split(text, separator),
        lambda part, i: F.struct(F.length(part).alias("n"), (-i).alias("i"), part.alias("part")),
    )
    return F.array_max(ranked)["part"]


def normalize(text: Column, separator: str = "[.]", required: str = "Cc", least: int = 2,
              canonical: Column | None = None) -> Column:
    """Isotope numbers removed, null when fewer than ``least`` of the required
    characters occur (the C of Cl counts), then the longest fragment.

    ``canonical`` is an already canonical form to use in place of the stripped
    text, for callers with a chemistry toolkit.
    """
    stripped = strip_isotopes(text)
    body = stripped if canonical is None else canonical
    return F.when(count_chars(stripped, required) >= least, longest_part(body, separator))


def element_count(tokens: Column, symbols: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*symbols)))


def element_counts(tokens: Column, symbols: Sequence[str] = ATOM_TOKENS) -> Column:
    """Array of ``element, n`` for the symbols that occur, in the order given.

    One pass picks the atoms out of the tokens. A symbol's number then follows from the length of the text of all
    atoms, each between two marks, without it.
    """
    atoms = F.filter(tokens, lambda t: t.isin(*symbols))
    marked = F.concat(F.lit("\n"), F.array_join(atoms, "\n\n"), F.lit("\n"))

    def counts(text: Column) -> Column:
        return F.array(*[F.struct(F.lit(s).alias("element"), (
            (F.length(text) - F.length(F.replace(text, F.lit(f"\n{s}\n"), F.lit("")))) / (len(s) + 2)).cast("int").alias("n"))
            for s in symbols])

    once = F.transform(F.array(marked), counts)[0]  # the text is a variable, so that it is made once
    return F.filter(once, lambda c: c["n"] > 0)


def branch_depth(tokens: Column) -> Column:
    """Deepest nesting of parentheses."""
    state = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top")),
        lambda acc, t: F.struct(
            (acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
            F.greatest(
                acc["top"],
                acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0),
            ).alias("top"),
        ),
    )
    return state["top"]


def token_descriptors(text: Column, tokens: Column) -> dict[str, Column]:
    """Descriptor columns that follow from the notation alone."""
    return {
        "length": F.length(text),
        "n_tokens": F.size(tokens),
        "n_carbon": element_count(tokens, CARBON_TOKENS),
        "n_hetero": element_count(tokens, HETERO_TOKENS),
        "n_rings": F.floor(F.size(ring_labels(text)) / 2).cast("int"),
        "branch_depth": branch_depth(tokens),
    }


def generic_tokens(tokens: Column) -> Column:
    """Every atom becomes ``C`` and bonds vanish: the coarse key of the generic
    scaffold test."""
    kept = F.filter(tokens, lambda t: ~t.isin(*BOND_TOKENS))
    return F.transform(kept, lambda t: F.when(t.isin(*ATOM_TOKENS), F.lit("C")).otherwise(t))


def penalized_score(base: Column, penalty: Column, rings: Column, valid: Column, allowed: Column,
                    masked: bool = True, default: float = -5.0) -> Column:
    """base - penalty - rings; ``default`` for invalid or masked-out rows."""
    bad = ~F.coalesce(valid, F.lit(False))
    if masked:
        bad = bad | ~F.coalesce(allowed, F.lit(False))
    return F.when(bad, F.lit(default)).otherwise(base - penalty - rings)


def score_or_default(valid: Column, score: Column, default: float = -1.0) -> Column:
    """Any score, with a default for invalid rows and missing scores."""
    return F.coalesce(F.when(valid, score), F.lit(default))


def zero_padded(index: Column, width: Column, prefix: str | None = None) -> Column:
    padded = F.lpad(index.cast("string"), width, F.lit("0"))
    return padded if prefix is None else F.concat_ws("_", F.lit(prefix), padded)
