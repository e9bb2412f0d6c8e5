"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is cut where no piece of the vocabulary reaches across: between a
character and a following space, and around line feeds. In each part the
agenda holds the adjacent pairs that form a piece; the best score, then the
leftmost, is taken first, and skipped if a keyed hash of seed, document, place
of the part, place in the part and piece falls below the dropout rate. So every
merge of every occurrence has a draw of its own, and every run gives the same ids.

A part's merges without dropout are remembered, the draws are not. Parts that
are new, and those with a skip among their merges, run through their agendas
side by side: one array holds the agendas of thousands of parts, and each step
takes the best entry of every one of them.

Every symbol that is no piece, and the space mark itself where it stands in a
text, is written as bytes, so that decoding gives back the text exactly.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

PIECE_BPE = "piece_bpe_32k.model"
#: Keys under which the tests cut a part.
VARIANTS = 4
#: Parts, of one text or several, that are looked at together.
TOGETHER = 20_000
#: Parts whose agendas run side by side.
ABREAST = 4_096
#: Characters of a part up to which its agenda runs beside others.
SHORT = 64
_PARTS = re.compile(r" *[^ \n]+| +|\n+")
_SPACE = "▁"
#: Parts whose merges are kept by a worker; then the memory is cleared.
PATHS_KEPT = 500_000
_MASK = (1 << 64) - 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_MERGE_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Symbols are ids of pieces, this for none, or from the next number on characters that are no piece.
_NONE, _ODD = 1 << 16, 1 << 17
#: An agenda entry holds the rank of the score, the place and the piece that is formed; this is no entry.
_NEVER = 1 << 62
_PAIR_BITS = 18


def _merge_key(left: int, piece: int) -> int:
    return ((left + 1) * _MERGE_MIX[0] ^ (piece + 1) * _MERGE_MIX[1]) & _MASK


class _Path(NamedTuple):
    """A part without dropout: its ids, and the keys of its merges in order."""

    ids: bytes
    merges: bytes


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each span, one span after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


class _Rows:
    """Rows of different lengths, one after the other in an array that grows."""

    def __init__(self, kind: type):
        self.data, self.used, self.bounds, self.n = np.zeros(1 << 12, kind), 0, np.zeros(1 << 10, np.int64), 0

    def append(self, data: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(data) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.used + len(data)))
        if self.n + len(counts) >= len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * (self.n + len(counts)) + 1)
        self.data[self.used:self.used + len(data)] = data
        self.bounds[self.n + 1:self.n + 1 + len(counts)] = self.used + np.cumsum(counts)
        self.used, self.n = self.used + len(data), self.n + len(counts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The data of the given rows, and their lengths."""
        starts = self.bounds[rows]
        counts = self.bounds[rows + 1] - starts
        return self.data[_spans(starts, counts)], counts


class MergeDropout:
    def __init__(self, vocabulary: str, seed: int, rate: float):
        model = SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {i: int(pieces[i][1:-1], 16) for i in range(len(pieces)) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        normal = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {pieces[i]: i for i in normal}
        self.rank = {pieces[i]: (-model.get_score(i), i) for i in normal}
        self.order = {piece: score for piece, (score, _) in self.rank.items()}
        self.text = {i: pieces[i].replace(_SPACE, " ").encode() for i in normal} | {
            i: bytes([b]) for i, b in self.bytes.items()}
        if any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("pieces reach across the parts of a text")
        self.seed, self.below = seed, int(rate * (1 << 32))
        if len(pieces) > _NONE:
            raise ValueError("ids are kept in 16 bits")
        self.symbol = np.arange(0x110000, dtype=np.int32) + _ODD  # by code point
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = self.symbol[ord(_SPACE)]
        self._pair_table()
        self._forget()

    def _pair_table(self) -> None:
        """A hash table of the pairs of symbols that form a piece."""
        places = {score: k for k, score in enumerate(sorted(set(self.order.values())))}
        single = {c: int(self.symbol[ord(c)]) for p in self.ids for c in p}
        held = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                pair = [self.ids.get(p, single.get(p) if len(p) == 1 else None) for p in (piece[:cut], piece[cut:])]
                if None not in pair:
                    held[pair[0] << 21 | pair[1]] = places[self.order[piece]] << 24 | i
        self.pair_bits = max(_PAIR_BITS, (4 * len(held)).bit_length())
        self.pair_key = np.full((1 << self.pair_bits) + len(held) + 1, -1, np.int64)
        self.pair_value = np.zeros(len(self.pair_key), np.int64)
        slots = self._slots(np.array(list(held), np.int64)).tolist()
        for slot, (key, value) in zip(slots, held.items()):
            while self.pair_key[slot] >= 0:
                slot += 1
            self.pair_key[slot], self.pair_value[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_MERGE_MIX[0])) >> np.uint64(64 - self.pair_bits)).view(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Agenda entries of symbols and their right neighbours; ``row`` is the left one's place plus 1."""
        keys = left.astype(np.int64) << 21 | right
        slots = self._slots(keys)
        held = self.pair_key[slots]
        out = np.where(held == keys, self.pair_value[slots] | row << 16, _NEVER)
        more = np.flatnonzero((held != keys) & (held >= 0))
        while len(more):
            slots[more] += 1
            at = slots[more]
            held = self.pair_key[at]
            hit = held == keys[more]
            out[more[hit]] = self.pair_value[at[hit]] | row[more[hit]] << 16
            more = more[~hit & (held >= 0)]
        return out

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.root_ids, self.root_merges = _Rows(np.uint16), _Rows(np.uint64)
        self.root_symbols, self.root_pairs = _Rows(np.int32), _Rows(np.int64)

    def _skips(self, base: int, merge: int) -> bool:
        h = (base ^ merge) * _MIX[0] & _MASK
        return ((h ^ h >> 32) * _MIX[1] & _MASK) >> 32 < self.below

    def _skips_each(self, base: np.ndarray, merges: np.ndarray) -> np.ndarray:
        """As :meth:`_skips`, for arrays."""
        h = (base ^ merges) * np.uint64(_MIX[0])
        return ((h ^ (h >> np.uint64(32))) * np.uint64(_MIX[1])) >> np.uint64(32) < np.uint64(self.below)

    def part(self, part: str, base: int) -> bytes:
        """Ids of one part (little-endian 16-bit); ``base`` is the key of its occurrence."""
        return self._short(part, lambda left, piece: self._skips(base, _merge_key(left, piece)))

    def long_part(self, part: str, base: int) -> bytes:
        """As :meth:`part`, with a heap as agenda, for parts of any length and with space marks of their own."""
        return self._long(part, lambda left, piece: self._skips(base, _merge_key(left, piece)))

    def _learn(self, parts: list[str]) -> None:
        """Remember the symbols, first agendas, merges and ids without dropout of parts that are new."""
        text = "".join(parts)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        ends = counts.cumsum()
        pairs = np.full(len(symbols), _NEVER)
        inner = np.ones(len(symbols), bool)
        inner[ends - 1] = False
        inner = np.flatnonzero(inner)
        row = _spans(np.ones(len(parts), np.int64), counts)
        pairs[inner] = self._pairs(symbols[inner], symbols[inner + 1], row[inner])
        ids, n_ids, merges, n_merges = self._agendas(symbols, pairs, counts, None)
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.root_symbols.append(symbols, counts)
        self.root_pairs.append(pairs, counts)
        self.root_ids.append(ids, n_ids)
        self.root_merges.append(merges, n_merges)

    def _root(self, part: str) -> _Path:
        if part not in self.known:
            self._learn([part])
        row = np.array([self.known[part]])
        return _Path(self.root_ids.take(row)[0].tobytes(), self.root_merges.take(row)[0].tobytes())

    def _agendas(self, symbols: np.ndarray, pairs: np.ndarray, counts: np.ndarray, bases: np.ndarray | None) -> tuple:
        """Ids of parts, given by their symbols and first agendas, and the number of ids of each; parts of similar
        length go together. Without ``bases`` no merge is skipped, and the keys of the merges and their numbers follow."""
        starts, order = counts.cumsum() - counts, np.argsort(counts, kind="stable")
        made, made_counts, merges, merge_counts = [], [], [], []
        for at in range(0, len(order), ABREAST):
            some = order[at:at + ABREAST]
            n = counts[some]
            spans = _spans(starts[some], n)
            found = self._abreast(symbols[spans], pairs[spans], n, None if bases is None else bases[some])
            for held, new in zip((made, made_counts, merges, merge_counts), found):
                held.append(new)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))

        def in_order(data: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            flat, n = np.concatenate(data), np.concatenate(lengths)
            return flat[_spans((n.cumsum() - n)[back], n[back])], n[back]

        out = self._ids(*in_order(made, made_counts))
        return out if bases is not None else (*out, *in_order(merges, merge_counts))

    def _abreast(self, symbols: np.ndarray, pairs: np.ndarray, counts: np.ndarray, bases: np.ndarray | None) -> tuple:
        """The agendas of some parts, one per column, step by step; row 0 and the last row are borders.

        Symbols that are left and their numbers; keys of the merges and their numbers, if nothing is skipped.
        """
        n, high = len(counts), int(counts.max())
        columns = np.repeat(np.arange(n), counts)
        rows = _spans(np.ones(n, np.int64), counts)
        held = np.full((high + 2, n), _NONE, np.int32)
        held[rows, columns] = symbols
        agenda = np.full((high + 2, n), _NEVER)
        agenda[rows, columns] = pairs
        after = np.repeat(np.arange(1, high + 3, dtype=np.int32)[:, None], n, axis=1)
        before = after - 2
        origin = np.arange(n)
        made, makers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        while True:
            best = agenda.min(axis=0)
            live = np.flatnonzero(best < _NEVER)
            if not len(live):
                break
            if 4 * len(live) < 3 * len(origin):
                agenda, after, before, origin, best = (x[..., live] for x in (agenda, after, before, origin, best))
                live = np.arange(len(origin))
            best = best[live]
            row, piece = best >> 16 & 0xFF, best & 0xFFFF
            keys = row.astype(np.uint64) * np.uint64(_MERGE_MIX[0]) ^ (piece + 1).astype(np.uint64) * np.uint64(_MERGE_MIX[1])
            if bases is None:
                made.append(keys)
                makers.append(origin[live])
            else:
                skipped = self._skips_each(bases[origin[live]], keys)
                agenda[row[skipped], live[skipped]] = _NEVER
                live, row, piece = live[~skipped], row[~skipped], piece[~skipped]
            column = origin[live]
            right = after[row, live]
            beyond, left = after[right, live], before[row, live]
            held[row, column] = piece
            held[right, column] = _NONE
            agenda[right, live] = _NEVER
            after[row, live] = beyond
            before[beyond, live] = row
            m = len(live)
            new = self._pairs(np.concatenate((held[left, column], piece)), np.concatenate((piece, held[beyond, column])),
                              np.concatenate((left, row)))
            agenda[left, live], agenda[row, live] = new[:m], new[m:]
        held = held[1:-1].T
        left = held != _NONE
        makers = np.concatenate(makers)
        return (held[left], left.sum(axis=1), np.concatenate(made)[np.argsort(makers, kind="stable")],
                np.bincount(makers, minlength=n))

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and their number for every part; characters that are no piece become bytes."""
        odd = np.flatnonzero(symbols >= _ODD)
        if not len(odd):
            return symbols.astype(np.uint16), counts
        wide = np.ones(len(symbols), np.int64)
        coded = [[self.of_byte[b] for b in (_SPACE if c == " " else c).encode()]
                 for c in map(chr, (symbols[odd] - _ODD).tolist())]
        wide[odd] = list(map(len, coded))
        out = np.repeat(symbols.astype(np.uint16), wide)
        out[_spans((wide.cumsum() - wide)[odd], wide[odd])] = [i for c in coded for i in c]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, wide, len(counts)).astype(np.int64)

    def _short(self, part: str, skips: Callable[[int, int], bool]) -> bytes:
        if len(part) > 48 or _SPACE in part:
            return self._long(part, skips)
        symbols = list(part.replace(" ", _SPACE))
        place = list(range(len(symbols)))
        order, never = self.order.get, float("inf")
        agenda = [order(a + b, never) for a, b in zip(symbols, symbols[1:])]  # by place; short, so the least is looked up
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            merged = symbols[i] + symbols[i + 1]
            if self.below and skips(place[i], self.ids[merged]):
                agenda[i] = never
                continue
            symbols[i] = merged
            del symbols[i + 1], place[i + 1], agenda[i]
            if i:
                agenda[i - 1] = order(symbols[i - 1] + merged, never)
            if i < len(agenda):
                agenda[i] = order(merged + symbols[i + 1], never)
        out = []
        for symbol in symbols:
            piece = self.ids.get(symbol)
            if piece is None:
                out += [self.of_byte[b] for b in symbol.encode()]
            else:
                out.append(piece)
        return struct.pack(f"<{len(out)}H", *out)

    def _long(self, part: str, skips: Callable[[int, int], bool]) -> bytes:
        symbols: list[str | None] = [_SPACE if c == " " else (None if c == _SPACE else c) for c in part]
        literal = {k for k, s in enumerate(symbols) if s is None}
        symbols = [s or _SPACE for s in symbols]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, agenda = self.rank, []

        def propose(left: int, right: int) -> None:
            if left < 0 or right >= n or left in literal or right in literal:
                return
            found = rank.get(symbols[left] + symbols[right])
            if found:
                heapq.heappush(agenda, (found[0], left, right, len(symbols[left]) + len(symbols[right]), found[1]))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            _, left, right, size, piece = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of them has been merged since
            if self.below and skips(left, piece):
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        out = []
        for k, symbol in enumerate(symbols):
            if not symbol:
                continue
            if k not in literal and symbol in self.ids:
                out.append(self.ids[symbol])
            else:
                out += [self.of_byte[b] for b in symbol.encode()]
        return struct.pack(f"<{len(out)}H", *out)

    def encode(self, text: str | None, key: int) -> bytes:
        """Ids of a text; ``key`` (such as the document id) is part of the keyed hash. Empty for null and empty texts."""
        return next(self.encode_each([text], [key]))

    def encode_each(self, texts: list[str | None], keys: list[int]) -> Iterator[bytes]:
        """As :meth:`encode`, for texts in a row, which are looked at together."""
        def pieces() -> Iterator[tuple[list[str], np.ndarray, bool]]:
            """Parts of a text and their keys, ``TOGETHER`` at most, and whether the text ends with them."""
            for text, key in zip(texts, keys):
                parts = _PARTS.findall(" " + text) if text else []
                bases = self.bases(key, len(parts))
                for at in range(0, max(len(parts), 1), TOGETHER):
                    yield parts[at:at + TOGETHER], bases[at:at + TOGETHER], at + TOGETHER >= len(parts)

        def cut() -> Iterator[tuple[bytes, bool]]:
            ids, counts = self._cut_all([p for parts, _, _ in run for p in parts], np.concatenate([b for _, b, _ in run]))
            ends = np.concatenate(([0], counts.cumsum()))[np.cumsum([0] + [len(parts) for parts, _, _ in run])].tolist()
            for start, end, (_, _, last) in zip(ends, ends[1:], run):
                yield ids[start:end].tobytes(), last

        begun, run, held = [], [], 0
        given = pieces()
        while True:
            piece = next(given, None)
            if run and (piece is None or held + len(piece[0]) > TOGETHER):
                for ids, last in cut():
                    begun.append(ids)
                    if last:
                        yield b"".join(begun)
                        begun = []
                run, held = [], 0
            if piece is None:
                return
            run.append(piece)
            held += len(piece[0])

    def bases(self, key: int, n: int) -> np.ndarray:
        """The keys of the first ``n`` parts of a document."""
        place = np.arange(n, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 + self.seed * 0xD1B54A32D192ED03 & _MASK)
        place = (place ^ (place >> np.uint64(30))) * np.uint64(_MIX[0])
        return place ^ (place >> np.uint64(31))

    def _cut(self, parts: list[str], bases: np.ndarray) -> list[bytes]:
        """Ids of each part."""
        ids, counts = self._cut_all(parts, bases)
        ends = counts.cumsum().tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def _cut_all(self, parts: list[str], bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts and the number of each part's. The merges of all roots are drawn at once; parts with a skip run
        through their agendas again."""
        if len(self.known) > PATHS_KEPT:
            self._forget()
        rows = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = {parts[k] for k in np.flatnonzero(rows < 0).tolist()}
        if new:
            short = [p for p in new if len(p) <= SHORT and _SPACE not in p]
            if short:
                self._learn(short)
            rows = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        counts = np.zeros(len(parts), np.int64)
        whole = np.flatnonzero(rows >= 0)
        found = []  # places of parts and their ids
        if self.below and len(whole):
            merges, n = self.root_merges.take(rows[whole])
            drawn = np.concatenate(([0], self._skips_each(np.repeat(bases[whole], n), merges).cumsum()))
            ends = n.cumsum()
            again = whole[drawn[ends] > drawn[ends - n]]
            whole = whole[drawn[ends] == drawn[ends - n]]
            if len(again):
                symbols, n = self.root_symbols.take(rows[again])
                found.append((again, *self._agendas(symbols, self.root_pairs.take(rows[again])[0], n, bases[again])))
        found.append((whole, *self.root_ids.take(rows[whole])))
        # a part of great length, or with a space mark of its own, has a heap as agenda
        alone = np.flatnonzero(rows < 0)
        if len(alone):
            ids = [np.frombuffer(self.part(parts[k], base), "<u2") for k, base in zip(alone.tolist(), bases[alone].tolist())]
            found.append((alone, np.concatenate(ids), np.array(list(map(len, ids)))))
        for places, _, n in found:
            counts[places] = n
        starts = counts.cumsum() - counts
        out = np.empty(int(counts.sum()), np.uint16)
        for places, ids, n in found:
            out[_spans(starts[places], n)] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.text.__getitem__, np.asarray(ids).tolist()))
        return data.decode()[1:]  # without the space put in front


_MODELS: dict[tuple, MergeDropout] = {}


def model(vocabulary: str, seed: int, rate: float) -> MergeDropout:
    """The worker's encoder, built once per process."""
    key = (vocabulary, seed, rate)
    if key not in _MODELS:
        _MODELS[key] = MergeDropout(*key)
    return _MODELS[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, rate: float = 0.1,
           vocabulary: str = PIECE_BPE, decoded: str | None = None) -> DataFrame:
    """Per row: id and ``ids`` (array of ints); ``decoded`` names a column for the
    text that the ids decode to, made in the same pass. A null or empty text has no ids; repeated rows get equal ids;
    a null id counts as 0 in the hash; other columns are ignored; an empty table gives no rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = model(vocabulary, seed, rate)
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at:at + 500]
                keys = part["id"].fillna(0).astype("int64").tolist()
                ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in encoder.encode_each(part["text"].tolist(), keys)]
                out = pd.DataFrame({id_col: part["id"].to_numpy(), "ids": ids})
                yield out.assign(**{decoded: list(map(encoder.decode, ids))}) if decoded else out

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInPandas(run, f"{id_col} long, ids array<int>" + (f", {decoded} string" if decoded else ""))


def decode(encoded: DataFrame, out: str = "text", vocabulary: str = PIECE_BPE) -> DataFrame:
    """Add the decoded text of ``ids``; any segmentation decodes to the text it was made from."""
    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        decoder = model(vocabulary, 0, 0.0)
        return ids.map(decoder.decode)

    return encoded.withColumn(out, texts("ids"))
