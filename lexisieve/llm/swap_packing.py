"""Best-fit packing of token sequences with swap-based local search.

Documents stay whole unless they are longer than a sequence. First every task
encodes its own documents and keeps one narrow row per piece (document, place,
length, checksum), so that only these rows are dealt out again, evenly, in
batches of some 30,000 pieces. A batch is packed by best fit, longest first.
Then bins are emptied, the least filled first: its pieces are moved to, or
exchanged one for one, two for one or one for two with those of, other underfull
bins, always so that the sum of squared fills grows, which makes the search end.
It also ends when the batch has as few bins as its tokens allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.llm.common import by_size
from lexisieve.llm.spaced_encoding import WORD_BPE, encoder
from lexisieve.session import materialize

#: Pieces packed together.
BATCH = 32_768
#: Bins in a row that may resist being emptied before the search of a batch ends.
TRIES = 256
#: Neighbours in a bin's order that a piece is paired with for two-for-one exchanges, and pieces of the bin to be
#: emptied that are offered.
_NEAR, _OFFERED = 16, 16


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece by best fit, longest first: the fullest bin that has room, or a new one."""
    bins = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, number = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, own, number = capacity, number, number + 1
        bins[i] = own
        room -= length
        if room:
            with_room[room].append(own)
            rooms |= 1 << room
    return bins


class LocalSearch:
    """Empties bins of a packing. ``bins`` holds the bin of each piece and is changed in place; empty bins stay unused."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)

    def squared_fill(self) -> int:
        return int((self.fill * self.fill).sum())

    def run(self, tries: int = TRIES) -> np.ndarray:
        fewest = -(-int(self.lengths.sum()) // self.capacity)
        used, failed = int((self.fill > 0).sum()), 0
        resisted: set[int] = set()
        while used > fewest and failed < tries:
            open_bins = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            open_bins = [b for b in open_bins[np.argsort(self.fill[open_bins], kind="stable")].tolist() if b not in resisted]
            if not open_bins:
                break
            if self.empty(open_bins[0]):
                used, failed = used - 1, 0
                resisted.clear()
            else:
                failed += 1
                resisted.add(open_bins[0])
        return self.bins

    def empty(self, target: int) -> bool:
        """Whether ``target`` could be emptied. Every exchange kept raises the sum of squared fills."""
        lengths, bins, fill = self.lengths, self.bins, self.fill
        under = (fill < self.capacity) & (fill > 0)
        under[target] = False
        others = np.flatnonzero(under[bins])
        others = others[np.argsort(bins[others], kind="stable")]
        while fill[target]:
            own = np.flatnonzero(bins == target)
            own = own[np.argsort(-lengths[own], kind="stable")]
            best = self._move(target, own) or self._exchange(target, own[:_OFFERED], others)
            if best is None:
                return False
            give, take, to = best
            bins[give], bins[take] = to, target
            gain = int(lengths[give].sum() - lengths[take].sum())
            fill[to] += gain
            fill[target] -= gain
            others = np.flatnonzero(under[bins])
            others = others[np.argsort(bins[others], kind="stable")]
        return True

    def _move(self, target: int, own: np.ndarray):
        """The longest piece that fits into another bin, and the bin with the least room for it."""
        room = np.where(self.fill > 0, self.capacity - self.fill, 0)
        room[target] = 0
        most = int(room.max())
        for piece in own.tolist():
            length = self.lengths[piece]
            if length <= most:
                fits = np.flatnonzero((room >= length) & (self.fill + length > self.fill[target]))
                if len(fits):
                    return np.array([piece]), np.array([], np.int64), int(fits[room[fits].argmin()])
        return None

    def _exchange(self, target: int, own: np.ndarray, others: np.ndarray):
        """The exchange that moves most tokens out of ``target``: one for one, one for two, two for one."""
        lengths, fill = self.lengths, self.fill
        owners = self.bins[others]
        room = self.capacity - fill[owners]
        found = []
        singles = [(np.array([p]), int(lengths[p])) for p in own.tolist()]
        doubles = [(np.array([p, q]), int(lengths[p] + lengths[q])) for i, p in enumerate(own.tolist()) for q in own[i + 1:].tolist()]

        def look(gives, sizes, rooms, fills, taken):
            for give, length in gives:
                moved = length - sizes
                ok = (moved > 0) & (moved <= rooms) & (fills + moved > fill[target])
                if ok.any():
                    at = int(np.where(ok, moved, 0).argmax())
                    found.append((int(moved[at]), give, taken(at)))

        size = lengths[others]
        look(singles + doubles, size, room, fill[owners], lambda k: others[k:k + 1])
        for step in range(1, _NEAR):
            same = np.flatnonzero(owners[:-step] == owners[step:])
            if not len(same):
                break
            look(singles, size[same] + size[same + step], room[same], fill[owners[same]],
                 lambda k, same=same, step=step: others[[same[k], same[k] + step]])
        if not found:
            return None
        _, give, take = max(found, key=lambda f: f[0])
        return give, take, int(self.bins[take[0]])


def pack(lengths: np.ndarray, capacity: int, tries: int = TRIES) -> np.ndarray:
    """Bin of each piece; no bin holds more than ``capacity``."""
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run(tries)


def cut_documents(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str,
                  with_ids: bool) -> DataFrame:
    """``key, <id>, piece, start, length, ids_crc32`` (and ``ids``): the pieces of all documents. ``key`` is unique."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 33
        for frame in frames:
            given = list(zip(frame["id"], frame["text"]))
            for run in by_size(given, [len(t or "") for _, t in given], 4_000_000):
                rows = []
                for (doc_id, _), ids in zip(run, encode([t for _, t in run])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part),
                                     *([np.frombuffer(part, "<i4")] if with_ids else [])))
                out = pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                out[id_col] = out[id_col].astype("Int64")
                out.insert(0, "key", key + np.arange(len(out)))
                key += len(out)
                yield out

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInPandas(pieces, f"key long, {id_col} long, piece int, start long, length long, ids_crc32 long"
                             + ", ids array<int>" * with_ids)


def place(pieces: DataFrame, capacity: int, batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """``key, sequence_id, offset`` for a table of pieces with ``key`` and ``length``. Pieces of a full sequence are
    sequences by themselves; the others are dealt out evenly and packed batch by batch."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        following = TaskContext.get().partitionId() << 33
        held, number = [], 0

        def flush() -> pd.DataFrame:
            nonlocal held, number, following
            rows = pd.concat(held).sort_values("key", ignore_index=True)
            held, number = [], 0
            lengths = rows["length"].to_numpy()
            bins = pack(lengths, capacity, tries)
            order = np.argsort(bins, kind="stable")
            sequence = np.unique(bins[order], return_inverse=True)[1]
            ends = np.cumsum(lengths[order])
            starts = ends - lengths[order]
            out = pd.DataFrame({"key": rows["key"].to_numpy()[order], "sequence_id": -1 - following - sequence,
                                "offset": starts - starts[np.searchsorted(sequence, sequence)]})
            following += int(sequence[-1]) + 1
            return out

        for frame in frames:
            held.append(frame)
            number += len(frame)
            if number >= 2 * batch:
                yield flush()
        if number:
            yield flush()

    short = pieces.where(F.col("length") < capacity).select("key", "length")
    tasks = max(1, -(-short.count() // batch))
    full = pieces.where(F.col("length") >= capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(short.repartition(tasks).mapInPandas(packed, "key long, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
                   vocabulary: str = WORD_BPE, with_ids: bool = False) -> DataFrame:
    """One row per piece: document, number of the piece in it, start in it, length, crc32 of its ids (as little-endian
    32-bit), sequence and offset in it. ``with_ids`` adds the ids as an array.

    Every document ends with ``end_id``; only documents longer than ``capacity`` are cut, into pieces of ``capacity``
    and a last shorter one. A null or empty text is the end id alone; repeated rows are packed as often as they occur;
    a null id stays null; other columns are ignored; an empty table gives no rows. Sequence ids are unique numbers.
    """
    pieces = materialize(cut_documents(docs, id_col, text_col, capacity, end_id, vocabulary, with_ids))
    return pieces.join(place(pieces, capacity), "key").drop("key").select(
        id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
