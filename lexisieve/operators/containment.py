"""Containment joins: rows whose set holds every element of a reference set.

This is the screening step of a substructure search (necessary, not
sufficient). Reference sets that are small enough, by measured size, go to every
task: a row meets those whose element rarest among the references it holds, and
rows stay where they are. Others are joined: each is looked up by its element that
is rarest among the rows, so only rows with that element become candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.descriptors import score_or_default
from lexisieve.functions.hashing import set_key
from lexisieve.session import BROADCAST_BYTES, arrow_rows, broadcast_if_bounded, materialize, plan_bytes, small_side

#: Sets sent to a Python worker at a time.
SETS_AT_ONCE = 256

_FIRST = 4  # elements of a reference set that are asked for before all of them
_GATHERED = 4_000_000  # elements asked for at a time


def _reference_sets(fragments: DataFrame, set_col: str, score: Column) -> DataFrame:
    """Distinct non-empty reference sets with the total score of their copies."""
    return (
        fragments.select(F.col(set_col).alias("frag_bits"), score.alias("score"))
        .where(F.size("frag_bits") > 0)
        .groupBy(set_key(F.col("frag_bits")).alias("frag_key"))
        .agg(F.first("frag_bits").alias("frag_bits"), F.sum("score").alias("score"))
    )


class _Lookup:
    """Reference sets as numbers of their elements, the rarest among the references first, in each task."""

    def __init__(self, table: pa.Table):
        lists = table.column("frag_bits").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        self.keys, self.scores = (pa.concat_arrays(table.column(c).chunks) for c in ("frag_key", "score"))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, elements = pd.factorize(lists.flatten().to_numpy(zero_copy_only=False))
        own, often = np.repeat(np.arange(len(lengths)), lengths), np.bincount(codes, minlength=len(elements))
        self.codes = codes[np.lexsort((codes, often[codes], own))]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.index, self.found = pd.Index(elements), np.zeros(len(elements), bool)
        self.first = self.codes[self.starts[:, None] + np.minimum(np.arange(_FIRST), lengths[:, None] - 1)]
        self.by_anchor = np.argsort(self.first[:, 0], kind="stable")
        self.anchored = np.bincount(self.first[:, 0], minlength=len(elements))
        self.at = np.cumsum(self.anchored) - self.anchored

    def _whole(self, refs: np.ndarray) -> np.ndarray:
        """The reference sets of which all elements are found."""
        ends = np.cumsum(self.lengths[refs])
        cuts = np.searchsorted(ends, np.arange(_GATHERED, int(ends[-1]), _GATHERED)) + 1
        kept = []
        for part in np.split(refs, np.unique(cuts)):
            n = self.lengths[part]
            if len(n):
                starts = np.cumsum(n) - n
                every = self.codes[np.repeat(self.starts[part] - starts, n) + np.arange(n.sum())]
                kept.append(part[np.logical_and.reduceat(self.found[every], starts)])
        return np.concatenate(kept)

    def contained(self, elements: np.ndarray) -> np.ndarray:
        """Numbers of the reference sets that lie in ``elements``, given as numbers."""
        n = self.anchored[elements]
        refs = self.by_anchor[np.repeat(self.at[elements] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.found[elements] = True
        refs = refs[self.found[self.first[refs]].all(1)]
        refs = self._whole(refs) if len(refs) else refs
        self.found[elements] = False
        return refs

    def pairs(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``id, row_bits`` and the reference sets that they contain."""
        lists = batch.column(1)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        values = lists.flatten()
        if values.null_count:
            row, values = row[values.is_valid().to_numpy(zero_copy_only=False)], values.drop_null()
        codes = self.index.get_indexer(values.to_numpy(zero_copy_only=False))
        row, codes = row[codes >= 0], codes[codes >= 0]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        refs = [self.contained(np.unique(part)) for part in np.split(codes, starts[1:])] if len(row) else []
        return np.repeat(row[starts], [len(r) for r in refs]), np.concatenate([np.zeros(0, np.int64), *refs])


def _pairs_in_place(df: DataFrame, refs: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """``id, frag_key, score`` from one reading of ``df``, whose rows stay where they are."""
    kinds = dict(df.dtypes)[id_col], dict(refs.dtypes)["score"]
    table = refs.where(F.forall("frag_bits", lambda e: e.isNotNull())).select("frag_key", "score", "frag_bits").toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(table)
        for batch in batches:
            rows, found = lookup.pairs(batch)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *(c.take(pa.array(found)) for c in (lookup.keys, lookup.scores))],
                    names=["id", "frag_key", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(set_col).alias("row_bits"))
    if not table.num_rows:
        return rows.join(refs.limit(0), F.lit(False)).select("id", "frag_key", "score")
    return rows.mapInArrow(run, f"id {kinds[0]}, frag_key string, score {kinds[1]}")


def containment_pairs(df: DataFrame, fragments: DataFrame, id_col: str, set_col: str,
                      fragment_set_col: str | None = None, score: Column | None = None) -> DataFrame:
    """``id, frag_key, score``: one row per row and distinct contained set. ``df`` is read once, or three times if the
    reference sets, of whole numbers or texts, are too large to go to every task."""
    refs = materialize(_reference_sets(
        fragments, fragment_set_col or set_col, F.lit(1.0) if score is None else score))
    if plan_bytes(refs) <= BROADCAST_BYTES and dict(refs.dtypes)["frag_bits"] in ("array<int>", "array<bigint>", "array<string>"):
        return _pairs_in_place(df, refs, id_col, set_col)
    elements = df.select(F.col(id_col).alias("id"), F.explode(set_col).alias("element"))
    ref_elements = materialize(refs.select("frag_key", F.explode("frag_bits").alias("element")))
    wanted = small_side(ref_elements.select("element").distinct())
    frequency = elements.join(wanted, "element", "left_semi").groupBy("element").agg(
        F.count(F.lit(1)).alias("df"))
    anchors = materialize(
        ref_elements.join(frequency, "element", "left")
        .groupBy("frag_key")
        .agg(F.min_by("element", F.struct(F.coalesce("df", F.lit(0)), "element")).alias("element"),
             F.min(F.coalesce("df", F.lit(0))).alias("df"))
        # an element that no row has rules the whole reference set out
        .where(F.col("df") > 0).select("frag_key", "element"))
    candidates = elements.join(broadcast_if_bounded(anchors), "element").select("id", "frag_key")
    rows = df.select(F.col(id_col).alias("id"), F.col(set_col).alias("row_bits"))
    return (
        candidates.join(rows, "id").join(refs, "frag_key")
        .where(F.size(F.array_except("frag_bits", "row_bits")) == 0)
        .select("id", "frag_key", "score")
    )


def remove_containing(df: DataFrame, fragments: DataFrame, id_col: str, set_col: str,
                      fragment_set_col: str | None = None) -> DataFrame:
    """Rows that contain none of the reference sets. An empty reference set
    matches nothing."""
    with arrow_rows(df.sparkSession, SETS_AT_ONCE):
        hits = small_side(containment_pairs(df, fragments, id_col, set_col, fragment_set_col).select(
            F.col("id").alias(id_col)).distinct())
    return df.join(hits, id_col, "left_anti").select(*df.columns)


def fragment_score(df: DataFrame, fragments: DataFrame, id_col: str, set_col: str, score_col: str,
                   fragment_set_col: str | None = None, valid: Column | None = None,
                   default: float = -1.0, out: str = "score") -> DataFrame:
    """Sum of the scores of the contained fragments; ``default`` when the sum is
    zero or the row is invalid."""
    pairs = containment_pairs(df, fragments, id_col, set_col, fragment_set_col, F.col(score_col))
    with arrow_rows(df.sparkSession, SETS_AT_ONCE):
        sums = small_side(pairs.groupBy(F.col("id").alias(id_col)).agg(F.sum("score").alias("__sum")))
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    nonzero = F.when(F.col("__sum") != 0, F.col("__sum"))
    return df.join(sums, id_col, "left").withColumn(out, score_or_default(ok, nonzero, default)).drop("__sum")


def one_fragment_score(df: DataFrame, fragment: DataFrame, set_col: str, out: str = "score") -> DataFrame:
    """1 when the row contains the one given set, else -1. ``fragment`` is a table
    of one row with a column ``set_col``."""
    wanted = fragment.select(F.lit(1).alias("__one"), F.col(set_col).alias("__wanted"))
    each = df.withColumn("__one", F.lit(1)).join(F.broadcast(wanted), "__one")  # one row
    inside = (F.size("__wanted") > 0) & (F.size(F.array_except("__wanted", F.col(set_col))) == 0)
    return each.withColumn(out, F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(-1)).drop("__one", "__wanted")
