"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each partition packs its own documents in one pass over their ids. Full
windows are cut off a document first. What is left is cut into pieces of a
quarter window at most and joins the partition's current batch; a batch is
dealt into windows by differencing: rows of one piece per window are partial
partitions, and the two with the largest spread are merged with opposing order
until one is left. If a window exceeds the capacity, the batch is dealt again
into more windows. No data move between tasks, so a hot source or key costs
nothing, and memory is bounded by a batch and one document.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.llm.common import by_size
from lexisieve.llm.encoding import BYTE_BPE, encoder

BATCH = 2048


def difference(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each piece and the windows' sums, by balanced multiway differencing."""
    order = np.argsort(-lengths, kind="stable")
    rows = -(-len(order) // windows)
    padded = np.full(rows * windows, -1)
    padded[:len(order)] = order
    sizes = np.where(padded < 0, 0, lengths[padded])
    heap = []
    for k in range(rows):
        sums = sizes[k * windows:(k + 1) * windows]
        heap.append((-int(sums.max() - sums.min()), k, sums, padded[None, k * windows:(k + 1) * windows]))
    heapq.heapify(heap)
    number = rows
    while len(heap) > 1:
        (_, _, a, in_a), (_, _, b, in_b) = heapq.heappop(heap), heapq.heappop(heap)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        sums = a[down] + b[up]
        heapq.heappush(heap, (-int(sums.max() - sums.min()), number, sums, np.vstack((in_a[:, down], in_b[:, up]))))
        number += 1
    sums, members = heap[0][2], heap[0][3]
    window = np.empty(len(lengths), np.int64)
    column = np.broadcast_to(np.arange(windows), members.shape)
    window[members[members >= 0]] = column[members >= 0]
    return window, sums


def deal(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; windows hold ``capacity`` at most and are nearly equal."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window, sums = difference(lengths, windows)
        if sums.max() <= capacity:
            return window
        windows += max(1, windows // 200)


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                   end_id: int = 0, vocabulary: str = BYTE_BPE, with_ids: bool = False) -> DataFrame:
    """One row per piece: document, start in it, length, crc32 of its ids (as
    little-endian 32-bit), the document's tokens, sequence and offset in it.
    ``with_ids`` adds the ids themselves as an array.

    Every document ends with ``end_id``. A null or empty text is one piece of
    the end id; repeated rows are packed as often as they occur; other columns
    are ignored; an empty table gives no rows. Sequence ids are unique, not
    consecutive: partition number above, counter of the partition below.
    """
    largest = max(1, capacity // 4)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary).encode, np.array([end_id], "<u2").tobytes()
        following = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def rows(parts: list[tuple], sequence, offset) -> pd.DataFrame:
            frame = pd.DataFrame({
                id_col: np.array([p[0] for p in parts], np.int64), "start": [p[1] for p in parts],
                "length": [len(p[2]) // 2 for p in parts],
                "ids_crc32": [zlib.crc32(np.frombuffer(p[2], "<u2").astype("<u4").tobytes()) for p in parts],
                "doc_tokens": [p[3] for p in parts], "sequence_id": sequence, "offset": offset})
            return frame.assign(ids=[np.frombuffer(p[2], "<u2").astype(np.int32) for p in parts]) if with_ids else frame

        def flush() -> pd.DataFrame:
            nonlocal held, following
            lengths = np.array([len(p[2]) // 2 for p in held])
            window = deal(lengths, capacity)
            order = np.argsort(window, kind="stable")
            sizes, sequences = lengths[order], window[order]
            ends = np.cumsum(sizes)
            first = np.searchsorted(sequences, sequences)
            frame = rows([held[i] for i in order], following + sequences, ends - sizes - (ends - sizes)[first])
            following += int(sequences[-1]) + 1
            held = []
            return frame

        for frame in frames:
            given = list(zip(frame["id"], frame["text"]))
            for run in by_size(given, [len(t or "") for _, t in given], 4_000_000):
                full = []
                for (doc_id, _), ids in zip(run, encode([t for _, t in run])):
                    ids += end
                    total = len(ids) // 2
                    whole = total - total % capacity
                    full += [(doc_id, at, ids[2 * at:2 * (at + capacity)], total) for at in range(0, whole, capacity)]
                    held += [(doc_id, at, ids[2 * at:2 * min(at + largest, total)], total)
                             for at in range(whole, total, largest)]
                if full:
                    yield rows(full, following + np.arange(len(full)), 0)
                    following += len(full)
                if len(held) >= BATCH:
                    yield flush()
        if held:
            yield flush()

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInPandas(pieces, f"{id_col} long, {_PIECES}" + ", ids array<int>" * with_ids)
