"""Token ids with vocabularies that drop white space and lower-case, chunk by chunk.

Such a vocabulary cuts words at white space at the latest, so the ids of a text
are the ids of its chunks between spaces, tabs and line ends in a row. Each
Python worker keeps the ids of chunks it has met. A new chunk is put together
from its words and marks, and the library is asked for new words only, in long
runs. Chunks with characters for which Python's ``re`` and ``str.lower`` might
differ from the vocabulary's own rules, and chunks that might hold a special
token, go to the library as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"

_LOWER = "a-zß-öø-ɏ"
#: Printable ASCII, white space of ASCII, and Latin letters but U+0130, which has two characters in lower case.
_PLAIN = re.compile(r"[ -~\t\n\rÀ-ÖØ-öø-įı-ɏ]*")
_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LOWER}]+|[0-9]|[^0-9{_LOWER}]+")
_WORD = re.compile(rf"[{_LOWER}]+")
_CHUNKS = re.compile(r"[^ \t\n\r]+")
_RUN = 2_000
#: Chunks, and words, kept by a worker (some 300 MB); then the memory is cleared and filled again.
CHUNKS_KEPT = 900_000


class SpacedEncoder:
    """``encode`` gives the ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str = WORD_BPE):
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.chunks: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ask(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, new: list[str]) -> None:
        words = self.words
        runs, others = [], []
        for word in new:
            (runs if _WORD.fullmatch(word) else others).append(word)
        for at in range(0, len(runs), _RUN):
            part = runs[at:at + _RUN]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.array(found.ids, "<u4"), np.array(found.word_ids)
            cuts = [0, *((np.flatnonzero(np.diff(owner)) + 1) * 4).tolist(), 4 * len(ids)]
            if len(cuts) != len(part) + 1:
                others += part
                continue
            data = ids.tobytes()
            words.update(zip(part, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
        for word in others:
            words[word] = self._ask(word)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        if len(self.words) > CHUNKS_KEPT:
            self.words.clear()
        words = self.words
        pieces = [_PIECES.findall(c) for c in new]
        self._learn_words(list({p for ps in pieces for p in ps if p not in words}))
        fresh = {c: b"".join([words[p] for p in ps]) for c, ps in zip(new, pieces)}
        if len(self.chunks) + len(fresh) > CHUNKS_KEPT:
            self.chunks.clear()
        self.chunks.update(fresh)
        return fresh

    def _as_it_is(self, text: str) -> bytes:
        """Of a text whose chunks go to the library unchanged."""
        if len(self.raw) > CHUNKS_KEPT // 10:
            self.raw.clear()
        out = []
        for chunk in _CHUNKS.findall(text):
            ids = self.raw.get(chunk)
            if ids is None:
                ids = self.raw[chunk] = self._ask(chunk)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; a null text is an empty one."""
        texts = ["" if t is None else t for t in texts]
        split = [t.lower().split() if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        get = self.chunks.get
        found = [None if cs is None else list(map(get, cs)) for cs in split]
        new = {c for cs, ids in zip(split, found) if ids and None in ids for c, x in zip(cs, ids) if x is None}
        fresh = self._learn(list(new)) if new else {}
        out = []
        for text, cs, ids in zip(texts, split, found):
            if ids is None:
                out.append(self._as_it_is(text))
            elif None in ids:
                out.append(b"".join([fresh[c] if x is None else x for c, x in zip(cs, ids)]))
            else:
                out.append(b"".join(ids))
        return out


_ENCODERS: dict[str, SpacedEncoder] = {}


def encoder(vocabulary: str = WORD_BPE) -> SpacedEncoder:
    """The worker's encoder, built once per process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = SpacedEncoder(vocabulary)
    return _ENCODERS[vocabulary]
