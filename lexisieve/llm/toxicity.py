"""Toxicity by weak supervision.

1. Terms (words, and beginnings of words) that mark toxic texts are mined from
   one part of the labelled training rows and dealt into lexicon voters; the
   next steps use the other part, where a chance term shows its weakness.
   Pattern voters look at the form of a text; one speaks for clean text.
2. A generative label model estimates every voter's accuracy by expectation
   maximisation, with the given label as one more, imperfect voter. Voters that
   agree beyond what the label explains are correlated; such voters share
   their weight.
3. A logistic regression learns the model's posterior from the voters'
   signals and scores all texts.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.llm.common import arrow_rows
from lexisieve.session import materialize

LEXICONS = 16
#: Beginnings of words, by length, which count as terms of their own.
PREFIXES = (4, 5, 6)
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"[.!?\n]+")
#: Words to each side of a hit that are looked at for shouting, inside its sentence.
AROUND = 8
#: Second person and a form of address. Fixed values.
_ADDRESS = re.compile(r"\b(?:you|your|you're|ur|du|dein|ihr|tu|toi|vous|usted)\b", re.IGNORECASE)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def terms_of(text: str) -> set[str]:
    """Distinct lower-case words, and beginnings of longer words marked with a star."""
    words = set(_WORDS.findall(text.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in PREFIXES))


@dataclass
class Model:
    """Terms with their lexicon, and the linear classifier over :func:`signals`."""

    lexicon: dict[str, int]
    weights: np.ndarray
    intercept: float


def hit_words(text: str, lexicon: dict[str, int]) -> dict[str, int]:
    """The distinct lower-case words that hit, with their lexicon. A word counts once, for its longest term."""
    found = {}
    for word in set(_WORDS.findall(text.lower())):
        for term in (word, *(word[:k] + "*" for k in reversed(PREFIXES) if len(word) > k)):
            if term in lexicon:
                found[word] = lexicon[term]
                break
    return found


def shouted(text: str, bad: Collection[str]) -> bool:
    """Whether anywhere in the text most letters around one of the lower-case words ``bad`` are capitals.

    Around are the words of its sentence or line, ``AROUND`` to each side at
    most, so neither the place of the passage nor the length of the text matters.
    """
    for sentence in _SENTENCES.split(text):
        if sentence.islower():
            continue
        words = _WORDS.findall(sentence)
        for k, word in enumerate(words):
            low = word.lower()
            if low in bad or not word.isascii() and any(w in bad for w in _WORDS.findall(low)):
                near = "".join(words[max(0, k - AROUND):k + AROUND + 1])
                if 2 * sum(map(str.isupper, near)) > len(near):
                    return True
    return False


def signals(text: str, lexicon: dict[str, int]) -> list[float]:
    """Per lexicon log(1 + hits); then any hit, log of all hits, shouting around a hit, exclamation, address.
    All of them are taken from the whole text."""
    bad = hit_words(text, lexicon)
    found, total = Counter(bad.values()), len(bad)
    return [*(math.log1p(found[k]) for k in range(LEXICONS)), float(total > 0), math.log1p(total),
            float(total > 0 and shouted(text, bad)), float("!!" in text), float(total > 0 and bool(_ADDRESS.search(text)))]


def context(text: str) -> int:
    """A minhash of the words: near copies mostly share it."""
    return min((zlib.crc32(w.encode()) for w in _WORDS.findall(text.lower())), default=0)


def mine(sample: DataFrame, least: int, tolerance: float, most_terms: int) -> dict[str, int]:
    """Terms of toxic texts in ``least`` contexts or more, and in at most ``tolerance`` as many clean texts.

    Contexts are counted, not texts, so that the words of one much-copied toxic
    text don't pass for toxic words. Counts are added up in each task first.
    The best ``most_terms`` are kept; each lexicon holds terms of like frequency.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = set(), Counter()
        for frame in frames:
            for text, label in zip(frame["text"], frame["toxic"]):
                if label:
                    toxic.update((t, c) for c in [context(text)] for t in terms_of(text))
                else:
                    clean.update(terms_of(text))
        rows = itertools.chain(((t, c, 0) for t, c in toxic), ((t, None, n) for t, n in clean.items()))
        while part := list(itertools.islice(rows, 50_000)):
            yield pd.DataFrame(part, columns=["term", "context", "n_clean"]).astype({"context": "Int64"})

    counts = sample.select("text", "toxic").mapInPandas(count, "term string, context long, n_clean long")
    sums = counts.groupBy("term").agg(F.countDistinct("context").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    good = sums.where((F.col("n_toxic") >= least) & (F.col("n_clean") <= tolerance * F.col("n_toxic")))
    best = good.orderBy(F.desc("n_toxic"), "n_clean", "term").limit(most_terms).collect()
    return {row.term: k * LEXICONS // len(best) for k, row in enumerate(best)}


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Accuracies, weights and posteriors from votes (1 toxic, 0 clean, -1 abstains; rows are texts).

    An abstention says nothing. Accuracies start at 0.9 and follow the
    posteriors. The residual correlation of two voters, where both vote, is
    taken after the posterior is removed; a voter's weight is divided by one
    plus its positive correlations.
    """
    n, voters = votes.shape
    voted = votes >= 0
    accuracy, shared = np.full(voters, 0.9), np.ones(voters)
    for step in range(rounds):
        strength = np.log(accuracy / (1 - accuracy)) / shared
        logit = math.log(prior / (1 - prior)) + np.where(voted, np.where(votes == 1, strength, -strength), 0).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        right = np.where(votes == 1, posterior[:, None], 1 - posterior[:, None])
        before = accuracy
        accuracy = np.clip((np.where(voted, right, 0).sum(axis=0) + 9) / (voted.sum(axis=0) + 10), 0.55, 0.999)
        if step % 10 == 5:
            residual = np.where(voted, votes - posterior[:, None], 0)
            norm = np.sqrt((residual ** 2).sum(axis=0)) + 1e-9
            correlation = np.clip(residual.T @ residual / np.outer(norm, norm), 0, 1)
            shared = 1 + np.where(correlation > 0.3, correlation, 0).sum(axis=0) - np.diag(correlation)
        if np.abs(accuracy - before).max() < 1e-6 and step > 16:
            break
    return accuracy, shared, posterior


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = 24_000, least_share: float = 0.01, tolerance: float = 0.02, most_terms: int = 4_000) -> Model:
    """Learn from ``sample_rows`` labelled rows at most, never from held-out ones.

    Rows enter the sample by a hash of the id. Null labels and ids are left
    out; a null text is an empty one. With no label of one of the two kinds the
    model scores every text with the share of toxic labels.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("id").agg(
        F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "id"))  # bounded by sample_rows
    known = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    base = (known.toxic or 0) / max(known.n, 1)
    if not 0 < base < 1:
        size = LEXICONS + 5
        return Model({}, np.zeros(size), math.log((base + 1e-3) / (1 - base + 1e-3)))
    mined = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10)) < 6
    lexicon = mine(sample.where(mined), max(2, round(0.6 * least_share * known.toxic)), tolerance, most_terms)

    def signal_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [signals(t, lexicon) for t in frame["text"]], "toxic": frame["toxic"]})

    rows = sample.where(~mined).select("text", "toxic").mapInPandas(signal_rows, "x array<double>, toxic int").toPandas()  # bounded
    x, gold = np.array(rows["x"].tolist()), rows["toxic"].to_numpy()
    any_hit = x[:, LEXICONS] > 0
    lexicons = np.where(x[:, :LEXICONS] > 0, 1, -1)
    patterns = np.where((x[:, LEXICONS + 2:] > 0) & any_hit[:, None], 1, -1)
    clean = np.where(any_hit, -1, 0)[:, None]
    _, _, posterior = label_model(np.hstack((lexicons, patterns, clean, gold[:, None])), base)
    spark = docs.sparkSession
    soft = pd.DataFrame({"x": x.tolist() * 2, "label": [1.0] * len(x) + [0.0] * len(x),
                         "weight": np.concatenate((posterior, 1 - posterior))})
    frame = spark.createDataFrame(soft[soft["weight"] > 1e-6]).coalesce(4).select(
        array_to_vector("x").alias("features"), "label", "weight").cache()
    try:
        linear = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=100, standardization=False).fit(frame)
    finally:
        frame.unpersist()
    return Model(lexicon, np.array(linear.coefficients.toArray()), float(linear.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that each text is toxic. A null text is an empty one, scored like any other;
    every row keeps its columns (one named ``out`` is replaced); repeated rows get equal scores."""
    lexicon, weights, intercept = model.lexicon, model.weights, model.intercept

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        z = np.array([signals(t or "", lexicon) for t in text]).reshape(len(text), -1) @ weights + intercept
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, probability(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns. They are written to the shared folder,
    and a thousand texts at a time go to a worker."""
    names = list(columns or docs.columns)
    held = docs.select(F.struct(*names).alias("row"), F.col("text"))
    with arrow_rows(docs.sparkSession, 1_000):
        return materialize(score(held, fit(docs, labels)).where(F.col("score") < threshold).select("row.*"))
