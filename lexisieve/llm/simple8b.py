"""Simple-8b: token ids in 64-bit words.

Each word holds a 4-bit selector and as many equally wide ids as fit the other
60 bits. An id that is too wide for the width which suits its neighbours is an
escape: its slot holds all ones, and the id itself stands in the exception list
of the block. A payload is a row of blocks with offsets in front, so that a
reader can decode any block alone, all words of one selector at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.llm.common import by_size
from lexisieve.llm.encoding import BYTE_BPE, encoder
from lexisieve.session import default_partitions

#: Selector -> (ids per word, bits per id). Fixed values of the coding.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10),
             (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK_IDS = 16_384
CHUNK_IDS = 1 << 17
_MAGIC = b"LS8B"


def _pack_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one block and the positions of its escapes.

    Selectors with an escape code are used at widths 12 and 15 where one id in
    eight at most would need it; all others hold their ids plainly.
    """
    n = len(ids)
    need = np.frexp(ids.astype(np.float64))[1]  # bit lengths
    escape_bits = next((b for b in (12, 15) if np.count_nonzero(ids >= (1 << b) - 1) * 8 <= n), 0)
    escaped = ids >= (1 << escape_bits) - 1 if escape_bits else np.zeros(n, bool)
    if escape_bits:
        need = np.where(escaped, escape_bits, need)
        ids = np.where(escaped, np.uint64((1 << escape_bits) - 1), ids)
    choice = np.full(n, 15, np.uint8)
    narrow = np.cumsum(np.bincount(need, minlength=61))
    for selector in range(14, -1, -1):
        count, bits = SELECTORS[selector]
        if narrow[bits] < count:
            continue
        wide = np.concatenate(([0], np.cumsum(need > bits, dtype=np.int32)))
        fits = wide[count:] == wide[:-count]
        choice[:n - count + 1][fits] = selector
    counts = np.array([c for c, _ in SELECTORS])[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += counts[at]
    starts = np.array(starts, np.int64)
    selectors = choice[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        count, bits = SELECTORS[selector]
        if not bits:
            continue
        rows = np.flatnonzero(selectors == selector)
        values = ids[starts[rows][:, None] + np.arange(count)]
        words[rows] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words, np.flatnonzero(escaped)


def pack(ids: np.ndarray) -> bytes:
    """All ids (unsigned, below 2**32) as magic, counts, block offsets and blocks."""
    ids = np.asarray(ids, np.uint64)
    if ids.max(initial=0) >> np.uint64(32):
        raise ValueError("ids have 32 bits at most")
    blocks, offsets, size = [], [], 0
    for at in range(0, len(ids), BLOCK_IDS):
        part = ids[at:at + BLOCK_IDS]
        words, escaped = _pack_block(part)
        block = b"".join((struct.pack("<III", len(part), len(words), len(escaped)), words.astype("<u8").tobytes(),
                          escaped.astype("<u2").tobytes(), part[escaped].astype("<u4").tobytes()))
        offsets.append(size)
        blocks.append(block)
        size += len(block)
    head = _MAGIC + struct.pack("<II", len(ids), len(blocks)) + np.array(offsets, "<u8").tobytes()
    return head + b"".join(blocks)


def unpack_block(payload: bytes, number: int) -> np.ndarray:
    """The ids of one block, found by its offset."""
    _, blocks = struct.unpack_from("<II", payload, 4)
    at = 12 + 8 * blocks + struct.unpack_from("<Q", payload, 12 + 8 * number)[0]
    n, n_words, n_escaped = struct.unpack_from("<III", payload, at)
    words = np.frombuffer(payload, "<u8", n_words, at + 12)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint32)
    for selector in np.unique(selectors):
        count, bits = SELECTORS[selector]
        if not bits:
            continue
        rows = np.flatnonzero(selectors == selector)
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[starts[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    at += 12 + 8 * n_words
    escaped = np.frombuffer(payload, "<u2", n_escaped, at)
    out[escaped] = np.frombuffer(payload, "<u4", n_escaped, at + 2 * n_escaped)
    return out[:n]


def unpack(payload: bytes) -> np.ndarray:
    if payload[:4] != _MAGIC:
        raise ValueError("not a Simple-8b payload")
    blocks = struct.unpack_from("<II", payload, 4)[1]
    return np.concatenate([np.zeros(0, np.uint32), *(unpack_block(payload, i) for i in range(blocks))])


_CHUNKS = "part int, first long, n_ids long, doc_ids binary, doc_lengths binary, payload binary"


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
              vocabulary: str = BYTE_BPE) -> None:
    """Encode every text and write the ids, ordered by document id, to ``path``.

    The files are Parquet, one row per chunk of about ``CHUNK_IDS`` ids in whole
    documents: range partition, ids before it in that partition, ids in it,
    the documents' ids and lengths, and the Simple-8b payload. Spark's
    committer keeps them whole when a task is tried again.
    A null text is empty and holds the end id only; rows that repeat a document
    id stay, in any order among themselves; an empty table writes no rows.
    """
    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary).encode, np.array([end_id], "<u2").tobytes()
        part, before, held, held_ids = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pd.DataFrame:
            lengths = np.array([len(x) // 2 for _, x in held], "<u4")
            ids = np.frombuffer(b"".join(x for _, x in held), "<u2")
            return pd.DataFrame({"part": [part], "first": [before], "n_ids": [len(ids)],
                                 "doc_ids": [np.array([i for i, _ in held], "<i8").tobytes()],
                                 "doc_lengths": [lengths.tobytes()], "payload": [pack(ids)]})

        for frame in frames:
            rows = list(zip(frame["id"], frame["text"]))
            for run in by_size(rows, [len(t or "") for _, t in rows], 4_000_000):
                for (doc_id, _), ids in zip(run, encode([t for _, t in run])):
                    held.append((doc_id, ids + end))
                    held_ids += len(ids) // 2 + 1
                    if held_ids >= CHUNK_IDS:
                        yield chunk()
                        before, held, held_ids = before + held_ids, [], 0
        if held:
            yield chunk()

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(default_partitions(docs.sparkSession), "id").sortWithinPartitions("id")
    ordered.mapInPandas(chunks, _CHUNKS).write.parquet(path)


def read_ids(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, decoded from the files: id, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` over little-endian 32-bit ids."""
    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                data = memoryview(unpack(row.payload).astype("<u4").tobytes())
                lengths = np.frombuffer(row.doc_lengths, "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pd.DataFrame({id_col: np.frombuffer(row.doc_ids, "<i8"), "start": row.base + row.first + ends - lengths,
                                    "n_tokens": lengths, "ids_crc32": np.array(crcs, np.int64)})

    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    return chunks.join(F.broadcast(bases), "part").mapInPandas(  # bounded: a row per partition
        documents, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
