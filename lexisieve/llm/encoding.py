"""Token ids of whole texts with the tokenizers library, word by word.

A byte-level BPE vocabulary splits a text by a fixed pattern and merges inside
each word only, so the ids of a text are the ids of its words in a row. Each
Python worker keeps the ids of the words it has met, and asks the library's model for
new ones. Texts with a special token, and texts with characters for which Python's ``re`` might
split differently from the vocabulary's own pattern go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The vocabulary's split pattern in the terms of ``re``, right for ``_PLAIN`` texts.
_SPLIT = re.compile(
    rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^ \t\n\r0-9{_LETTERS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: Printable ASCII, tab, line ends, and Latin letters: here both patterns agree.
_PLAIN = re.compile(rf"[ -~\t\n\r{_LETTERS}]*")
_SPACED_WORD = re.compile(rf" [{_LETTERS}]+")
#: Printable stand-ins of the UTF-8 bytes, as byte-level vocabularies write them, for the characters of a spaced word.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
_ID_BYTES = [i.to_bytes(2, "little") for i in range(1 << 16)]
_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x250))}
_PROBES = (" the", " naïve", " Ünïcödé", " ɏǅĀſ", " counterrevolutionaries")
#: Words kept by a worker (some 250 MB); then the memory is cleared and filled again.
WORDS_KEPT = 1_200_000


class WordEncoder:
    """``encode`` gives the uint16 ids of a text as little-endian bytes. With ``literal`` the vocabulary's special
    tokens are ordinary text where they occur in a text."""

    def __init__(self, vocabulary: str, literal: bool = False):
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.library.encode_special_tokens = literal
        self.special = [] if literal else [t.content for t in self.library.get_added_tokens_decoder().values()]
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.known: dict[str, bytes] = {}
        self.model = self.library.model if self.library.normalizer is None else None
        if self.model is not None and any(self._merged(w) != self._whole(w) for w in _PROBES):
            self.model = None  # not a vocabulary of bytes: words go to the library whole

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _merged(self, word: str) -> bytes:
        """A space and letters, which the vocabulary's pattern leaves whole, straight from the merges of its model."""
        return b"".join([_ID_BYTES[t.id] for t in self.model.tokenize(word.translate(_BYTES))])

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        others, fresh = [], {}
        for word in words:
            if self.model is not None and _SPACED_WORD.fullmatch(word):
                fresh[word] = self._merged(word)
            else:
                others.append(word)
        for word in others:
            fresh[word] = self._whole(word)
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
        self.known.update(fresh)
        return fresh

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; a null text is an empty one."""
        texts = ["" if t is None else t for t in texts]
        words = [_SPLIT.findall(t) if _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        get = self.known.get
        found = [None if ws is None else list(map(get, ws)) for ws in words]
        new = {w for ws, ids in zip(words, found) if ids and None in ids for w, x in zip(ws, ids) if x is None}
        fresh = self._learn(new) if new else {}
        out = []
        for text, ws, ids in zip(texts, words, found):
            if ids is None:
                out.append(self._whole(text))
            elif None in ids:
                out.append(b"".join([fresh[w] if x is None else x for w, x in zip(ws, ids)]))
            else:
                out.append(b"".join(ids))
        return out


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(vocabulary: str = BYTE_BPE, literal: bool = False) -> WordEncoder:
    """The worker's encoder, built once per process."""
    if (vocabulary, literal) not in _ENCODERS:
        _ENCODERS[vocabulary, literal] = WordEncoder(vocabulary, literal)
    return _ENCODERS[vocabulary, literal]
