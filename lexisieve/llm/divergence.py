"""Quality rules by distribution divergence, with DataFrame functions only.

A document's character classes and common words are counted, the counts of all
passing documents of a language are its reference, and a document that lies
too far from it (Jensen-Shannon distance, base 2) is rejected. Short documents
are not judged by a histogram that is mostly noise at their length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.barrier import evaluate_once
from lexisieve.session import materialize

#: Frequent function words of each language. Fixed values.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
#: Character classes as sets for a regular expression; white space and the rest follow.
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r".,;:'\"()?-", r"!#*$%&|<>"]

_SPACES = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def _repeat_words(df: DataFrame, width: int) -> DataFrame:
    """Add ``n_repeat_words`` for ``__words``: words covered by windows that occur twice or more.

    Windows are compared by 64-bit hash. Positions are sorted by hash only in
    texts that have an equal pair at all.
    """
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    df = evaluate_once(df, __h=hashes)
    windows = F.when(F.size("__h") >= width, F.transform(
        F.sequence(F.lit(0), F.size("__h") - width),
        lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))
    df = evaluate_once(df, __w=windows)
    some = F.size(F.array_distinct("__w")) < F.size("__w")
    ordered = F.when(some, F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = evaluate_once(df.drop("__h"), __s=ordered)
    twice = F.filter("__s", lambda x, i: (F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"]))
    df = evaluate_once(df.drop("__w"), __p=F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.least(F.lit(width), F.coalesce(F.get("__p", i + 1) - p, F.lit(width)))),
        F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__s", "__p")


def measure(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
            common: Mapping[str, Sequence[str]] = COMMON) -> DataFrame:
    """Each row as struct ``row`` with its counts: ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` and the histograms ``classes`` and ``common``."""
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"))
    df = evaluate_once(df.withColumn("__text", text).withColumn("__lang", F.col(f"row.{lang_col}").cast("string")),
                       __words=words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    classes = [F.length("__text") - F.length(F.regexp_replace("__text", f"[{c}]+", "")) for c in CLASSES]
    df = evaluate_once(
        df, __lines=lines, n_words=F.size("__words").cast("long"),
        __spaces=F.length("__text") - F.length(F.translate("__text", " " + _SPACES, "")),
        n_symbols=(F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long"),
        __classes=F.array(*classes),
        __hits=reduce(lambda rest, lang: F.when(F.col("__lang") == lang, F.filter(
            "__words", lambda w: w.isin(*common[lang]))).otherwise(rest), common, F.array().cast("array<string>")))
    df = df.withColumns({
        "word_chars": (F.length("__text") - F.col("__spaces")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "classes": F.concat("__classes", F.array("__spaces", F.length("__text") - F.col("__spaces") - F.aggregate(
            "__classes", F.lit(0), lambda a, x: a + x))).cast("array<double>"),
        "common": reduce(lambda rest, lang: F.when(F.col("__lang") == lang, F.concat(
            F.transform(F.array(*map(F.lit, common[lang])), lambda w: F.size(F.filter("__hits", lambda x: x == w))),
            F.array((F.col("n_words") - F.size("__hits")).cast("int")))).otherwise(rest), common,
            F.lit(None).cast("array<int>")).cast("array<double>"),
    })
    df = _repeat_words(df.drop("__lines", "__spaces", "__classes", "__hits", "__text"), 5)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumnRenamed("__lang", "lang").drop("__words")


def _share(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(histogram, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, in [0, 1]) of two arrays of counts; null if either is empty or null."""
    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(_share(p), _share(q), lambda x, y: (term(x, y) + term(y, x)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def references(measured: DataFrame, least_words: int = 2_000) -> DataFrame:
    """Per language the summed histograms of its documents that pass the base rules."""
    sums = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)])
    width = 1 + max(map(len, COMMON.values()))
    return (measured.where(~F.col("base_failed") & F.col("lang").isNotNull()).groupBy("lang").agg(
        F.sum("n_words").alias("__n"), sums("classes", len(CLASSES) + 2).alias("ref_classes"),
        sums("common", width).alias("ref_common")).where(F.col("__n") >= least_words).drop("__n"))


def judge(docs: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text", lang_col: str = "lang",
          class_limit: float = 0.25, common_limit: float = 0.24, least_chars: int = 150,
          least_words: int = 80) -> DataFrame:
    """The columns ``keep`` (all by default) as struct ``row``, the counts of :func:`measure`,
    ``class_distance``, ``common_distance`` and ``kept``.

    Texts under ``least_chars`` word characters are not judged by character
    classes, those under ``least_words`` words not by common words, and
    languages without a reference not at all. A null text is an empty one and
    fails the base rules. A null or unknown language passes unless the base
    rules fail. Each row is judged alone, repeated or not. An empty table
    gives no rows.

    Texts are read once; counts (and what ``keep`` names) are written to the
    shared folder, and the references, a row per language, are summed from them.
    """
    measured = measure(docs, text_col, lang_col)
    if keep is not None:
        measured = measured.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in keep]))
    measured = materialize(measured)
    judged = measured.join(references(measured), "lang", "left").withColumns({
        "class_distance": F.when(F.col("word_chars") >= least_chars, js_distance(F.col("classes"), F.col("ref_classes"))),
        "common_distance": F.when(F.col("n_words") >= least_words, js_distance(F.col("common"), F.col("ref_common"))),
    })
    far = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("common_distance", F.lit(0.0)) > common_limit)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
