"""Set fingerprints of token sequences and their similarity.

The fingerprint is the q-gram set of the tokens (LINGO, Vidal et al. 2005, for
q = 4 on line notation). It is not a circular chemistry fingerprint; a caller
who has one passes its sorted on-bits as an array column instead.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.hashing import md5_int


def shingles(tokens: Column, q: int, sep: str = "") -> Column:
    """Texts of all windows of ``q`` tokens; fewer than ``q`` tokens give none."""
    return _windows(tokens, q, lambda parts: F.concat_ws(sep, *parts))


def _windows(tokens: Column, q: int, build) -> Column:
    """``tokens`` has to be a plain column, not an expression: it is looked up
    once per window, and an expression would be evaluated each time."""
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (q - 1), F.lit(0)))
    if q == 1:
        return F.transform(starts, lambda t: build([t]))
    return F.transform(
        starts, lambda t, i: build([t] + [F.get(tokens, i + k) for k in range(1, q)])
    )


def on_bits(tokens: Column, q: int = 4, n_bits: int = 1024, sep: str = "") -> Column:
    """Sorted distinct on-bits in [0, n_bits), hashed by md5 so that other
    engines can repeat them."""
    return F.sort_array(F.array_distinct(
        _windows(tokens, q, lambda parts: (md5_int(F.concat_ws(sep, *parts)) % n_bits).cast("int"))
    ))


def gram_set(tokens: Column, q: int = 3) -> Column:
    """Sorted distinct 64-bit q-gram hashes: the unfolded fingerprint, cheap to
    build and, unlike a folded one, not saturated by long texts."""
    return F.sort_array(F.array_distinct(_windows(tokens, q, lambda parts: F.xxhash64(*parts))))


def fold(bits: Column, n_bits: int) -> Column:
    """A wider fingerprint folded to ``n_bits``."""
    return F.sort_array(F.array_distinct(F.transform(bits, lambda b: (b % n_bits).cast("int"))))


def intersection_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def tanimoto_from_counts(shared: Column, size_a: Column, size_b: Column) -> Column:
    return F.when(shared > 0, shared / (size_a + size_b - shared)).otherwise(F.lit(0.0))


def tanimoto(a: Column, b: Column) -> Column:
    """|A n B| / |A u B|; two empty sets give 0."""
    return tanimoto_from_counts(intersection_size(a, b), F.size(a), F.size(b))


def passes_threshold(shared: Column, size_a: Column, size_b: Column, threshold: Fraction,
                     strict: bool) -> Column:
    """Integer form of tanimoto > / >= threshold, free of rounding at the border."""
    left = shared.cast("long") * threshold.denominator
    right = (size_a + size_b - shared).cast("long") * threshold.numerator
    return (shared > 0) & ((left > right) if strict else (left >= right))


def parse_threshold(text: str) -> tuple[Fraction, bool]:
    """``"==1"``, ``">0.85"`` or ``">=0.5"`` as (threshold, strict)."""
    text = text.strip()
    for mark, strict in ((">=", False), ("==", False), (">", True)):
        if text.startswith(mark):
            value = Fraction(text[len(mark):].strip())
            if mark == "==" and value != 1:
                raise ValueError("an equality threshold has to be 1")
            if not 0 <= value <= 1:
                raise ValueError("the threshold has to lie in [0, 1]")
            return value, strict
    raise ValueError(f"not a threshold: {text!r}")


def dense_bits(bits: Column, n_bits: int) -> Column:
    """0/1 array of length ``n_bits``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bits - 1)),
        lambda i: F.when(F.array_contains(bits, i), 1.0).otherwise(0.0),
    )


def dense_vector(bits: Column, n_bits: int) -> Column:
    return array_to_vector(dense_bits(bits, n_bits))


def add_sparse_vector(df: DataFrame, bits_col: str, n_bits: int, out: str = "features") -> DataFrame:
    """ML vector column that stores the on-bits only: the bit numbers are the
    vocabulary of a count vectoriser, which builds sparse vectors in the JVM."""
    model = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(n_bits)], inputCol="__words", outputCol=out
    )
    words = df.withColumn("__words", F.col(bits_col).cast("array<string>"))
    return model.setBinary(True).transform(words).drop("__words")
