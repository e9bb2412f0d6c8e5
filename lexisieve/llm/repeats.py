"""Periodic runs of words by recompression.

A run is a stretch of words that repeats with its smallest period several times
and that neither neighbour extends. Documents are looked at in chunks, joined
with a separator of its own after each. For every period a grid of positions is
tested, fine enough that every run holds a grid position with equal words a
period apart from it on (harmonic grid: the positions of all periods together
are some n log n). For the documents with such candidates, alternate block and
pair compression makes a run-length grammar: equal neighbours become one symbol
with a count, then pairs of a left and a right symbol become one symbol, until
all symbols differ. How far two positions agree to the right and to the left is
read off the grammar: both climb while they stand at the same edge of their
parents, step over equal symbols (over whole blocks at once), and go down where
symbols differ. These extensions are exact, so the runs are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.llm.common import by_size

#: Characters per chunk; a longer document is a chunk of its own.
CHUNK = 3_000_000
#: Words compared at a grid position before it becomes a candidate.
PROBE = 8
_BLOCK = 1_000_000
_FIRST, _LAST = 1, 2


class Grammar:
    """Run-length grammar of a sequence whose first and last symbols occur nowhere else.

    All levels lie in flat arrays, level 0 (the sequence itself) first: ``sym`` the symbol, ``up`` its parent (-1 on
    top), ``first``/``last`` its outer children, ``edge`` whether it is its parent's first or last child, and
    ``ahead``/``behind`` how many equal symbols follow from it on, or end with it.
    """

    def __init__(self, sequence: np.ndarray, seed: int = 1):
        self.n = len(sequence)
        self.seed, self.levels = seed, 0
        fresh, at, current = int(sequence.max()) + 1, 0, sequence.astype(np.int64)
        parts: dict[str, list] = {k: [] for k in ("sym", "up", "first", "last", "edge", "ahead", "behind")}
        first = last = np.zeros(len(current), np.int64)
        while True:
            starts, counts, fresh = self._blocks(current, fresh)
            if starts is None:
                starts, counts, fresh = self._pairs(current, fresh)
            size = len(current)
            index = np.arange(size)
            top = starts is None
            if top:
                up, edge, ahead, behind = np.full(size, -1), np.zeros(size), np.ones(size), np.ones(size)
            else:
                begins = np.zeros(size, np.int64)
                begins[starts] = 1
                parent = np.cumsum(begins) - 1
                ends = starts + counts
                up = at + size + parent
                edge = _FIRST * begins + _LAST * (index + 1 == ends[parent])
                if self._block:
                    ahead, behind = ends[parent] - index, index - starts[parent] + 1
                else:
                    ahead = behind = np.ones(size)
            for name, value, kind in (("sym", current, np.int32), ("up", up, np.int32), ("first", first, np.int32),
                                      ("last", last, np.int32), ("edge", edge, np.uint8), ("ahead", ahead, np.int32),
                                      ("behind", behind, np.int32)):
                parts[name].append(value.astype(kind))
            self.levels += 1
            if top:
                break
            first, last = at + starts, at + ends - 1
            at += size
            current = self._next
        for name, values in parts.items():
            setattr(self, name, np.concatenate(values))

    def _blocks(self, current: np.ndarray, fresh: int):
        """Starts and lengths of blocks of equal symbols, each a new symbol by symbol and length; None if all are single."""
        differs = current[1:] != current[:-1]
        self._block = not differs.all()
        if not self._block:
            return None, None, fresh
        starts = np.concatenate([[0], np.flatnonzero(differs) + 1])
        counts = np.diff(np.append(starts, len(current)))
        self._next = current[starts]
        many = counts > 1
        names, which = np.unique(self._next[many] << 31 | counts[many], return_inverse=True)
        self._next[many] = fresh + which
        return starts, counts, fresh + len(names)

    def _pairs(self, current: np.ndarray, fresh: int):
        """Starts and lengths (1 or 2) after joining left symbols with right symbols that follow them. Sides are drawn
        by symbol, so equal stretches are joined alike but for their ends. None if all symbols differ."""
        if len(np.unique(current)) == len(current):
            return None, None, fresh
        best, most = None, 0
        while not most:
            for _ in range(2):
                self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % (1 << 63)
                side = ((current * (self.seed | 1)) >> 40 & 1).astype(bool)
                for pair in (side[:-1] & ~side[1:], ~side[:-1] & side[1:]):
                    number = int(np.count_nonzero(pair))
                    if number > most:
                        best, most = pair, number
        at = np.flatnonzero(best)
        whole = np.ones(len(current), bool)
        whole[at + 1] = False
        starts = np.flatnonzero(whole)
        counts = np.diff(np.append(starts, len(current)))
        names, which = np.unique(current[at] << 31 | current[at + 1], return_inverse=True)
        self._next = current[starts]
        self._next[counts == 2] = fresh + which
        return starts, counts, fresh + len(names)

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """For how many symbols the sequence agrees from positions ``a`` and ``b`` (unequal) on, to the right or left."""
        child, run, mark, sign = (self.first, self.ahead, _FIRST, 1) if forward else (self.last, self.behind, _LAST, -1)
        start = a.astype(np.int64)
        x, y = start.copy(), b.astype(np.int64)
        climbing = np.ones(len(x), bool)
        active = np.arange(len(x))
        while len(active):
            p, q = x[active], y[active]
            same = self.sym[p] == self.sym[q]
            rise = same & climbing[active] & ((self.edge[p] & self.edge[q] & mark) != 0)
            step = sign * np.minimum(run[p], run[q])
            climbing[active[~same]] = False
            over = ~same & (p < self.n)
            x[active] = np.where(rise, self.up[p], np.where(same, p + step, np.where(over, p, child[p])))
            y[active] = np.where(rise, self.up[q], np.where(same, q + step, np.where(over, q, child[q])))
            active = active[~over]
        return sign * (x - start)


def grid_step(period, least: int, times: int):
    """Distance of grid positions for a period. Positions of a run whose word is equal a period later form a stretch of
    twice the step at least."""
    return np.maximum(1, np.maximum((times - 1) * period, least - period) // 2)


def candidates(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid positions and periods whose next words, up to the grid step and ``PROBE``, are equal a period later.

    ``words`` holds documents by descending ``sizes``, each closed by a separator at ``ends``; only documents long
    enough for a period are looked at.
    """
    top = int(sizes[0]) // times
    padded = np.concatenate([words, np.full(PROBE, -1, words.dtype)])
    long_enough = np.searchsorted(-sizes, -np.maximum(least, times * np.arange(top + 1)), side="right")
    found_at, found_period = [], []

    def probe(at: np.ndarray, period) -> None:
        step = grid_step(period, least, times)
        for t in range(1, PROBE):
            if not len(at):
                return
            keep = (padded[at + t] == padded[at + period + t]) | (t >= step)
            at = at[keep]
            if np.ndim(period):
                period, step = period[keep], step[keep]
        found_at.append(at)
        found_period.append(np.broadcast_to(period, at.shape))

    period = 1
    while period <= top:
        length = int(ends[long_enough[period] - 1])
        if length < 256 * period:
            break
        step = int(grid_step(period, least, times))
        equal = words[:length - period:step] == words[period:length:step]
        probe(np.flatnonzero(equal) * step, period)
        period += 1
    periods = np.arange(period, top + 1)
    lengths = ends[long_enough[period:top + 1] - 1]
    steps = grid_step(periods, least, times)
    counts = -(-np.maximum(lengths - periods, 0) // steps)
    cut = np.searchsorted(np.cumsum(counts), np.arange(0, int(counts.sum()) + _BLOCK, _BLOCK))
    for a, b in zip(cut, [*cut[1:], len(periods)]):
        if b > a:
            number = counts[a:b]
            at = (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * np.repeat(steps[a:b], number)
            period = np.repeat(periods[a:b], number)
            keep = padded[at] == padded[at + period]
            probe(at[keep], period[keep])
    if not found_at:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate(found_at), np.concatenate(found_period).astype(np.int64)


def runs_of_documents(documents: list[list], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """Rows ``start, length, period`` by start, then period, of the runs of each list of words."""
    out = [np.empty((0, 3), np.int64)] * len(documents)
    sizes = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(least, times)]
    if not len(order):
        return out
    sizes = sizes[order]
    ends = np.cumsum(sizes + 1) - 1
    joined = [w for k in order for w in documents[k]]
    codes, names = pd.factorize(np.array(joined, object))
    words = np.empty(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = codes
    words[ends] = len(names) + np.arange(len(ends))
    at, period = candidates(words, ends, sizes, least, times)
    if not len(at):
        return out
    owner = np.searchsorted(ends, at)
    chosen = np.unique(owner)
    # the grammar of the documents with candidates, behind a first symbol of its own
    begins = ends - sizes
    moved = 1 + np.cumsum(sizes[chosen] + 1) - (sizes[chosen] + 1)
    sequence = np.concatenate([[len(names) + len(ends)], *[words[begins[k]:ends[k] + 1] for k in chosen]])
    grammar = Grammar(sequence)
    local = np.searchsorted(chosen, owner)
    left = at - begins[owner] + moved[local]
    # a position a period later may lie behind the document: then it is no candidate
    keep = left + period < moved[local] + sizes[owner]
    left, period, local = left[keep], period[keep], local[keep]
    end = left + period + grammar.agree(left, left + period)
    start = left - grammar.agree(left - 1, left + period - 1, forward=False)
    keep = end - start >= np.maximum(least, times * period)
    rows = np.stack([local[keep], start[keep] - moved[local[keep]], end[keep] - start[keep], period[keep]], 1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # multiples of a period give the same stretch: the smallest counts
    rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(chosen) + 1))
    for k, a, b in zip(chosen, cuts, cuts[1:]):
        out[order[k]] = rows[a:b, 1:]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, without those that some run holds after its first period, joined by one space."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3,
              prepare: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``<id>, runs, collapsed``: the runs of words of every whole text, as an array of ``start, length, period`` by
    start, then period, and the text without repeated periods.

    Words are parted by the six ASCII white-space characters. A run repeats with its smallest period, is ``least``
    words and ``times`` periods long at least (``times`` from 2), and is not extended by a neighbour. ``prepare`` gets
    the id in decimal and the words, and returns the words to use. A null or empty text has no words: no runs, and an
    empty collapsed text. Every row is worked on by itself: repeated ids and null ids are rows like others; other
    columns are ignored; an empty table gives no rows.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            given = list(zip(frame["id"], frame["text"]))
            for chunk in by_size(given, [len(t or "") for _, t in given], CHUNK):
                words = [(t or "").encode().split() for _, t in chunk]
                if prepare is not None:
                    words = [prepare(i, w) for (i, _), w in zip(chunk, words)]
                runs = runs_of_documents(words, least, times)
                yield pd.DataFrame({
                    "id": [i for i, _ in chunk],
                    "runs": [[dict(zip(("start", "length", "period"), r)) for r in own.tolist()] for own in runs],
                    "collapsed": [collapse(w, r).decode() for w, r in zip(words, runs)]})

    given = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = given.mapInPandas(
        search, "id string, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.select(F.col("id").cast("long").alias(id_col), "runs", "collapsed")


def with_planted_run(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """Words of one document in ten (by the checksum of its id), repeating from some word on with some period."""
    n = len(words)
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * (-(-(n - a) // period)))[:n - a]


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of :func:`find_runs`: number of runs, the one of the greatest exponent (exact; ties: smallest
    start, then period), and digests of all runs and of the collapsed text."""
    none = "CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"
    best = F.expr(f"aggregate(runs, {none}, (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    written = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
