"""Token ids of whole texts by way of their white-space chunks.

A tokenizer whose pre-tokenizer never lets a token cross a blank or a newline gives, for a text, the concatenation of the ids of its chunks
between these. A bounded cache of chunks replaces most calls. A chunk not seen before that is a Latin word, perhaps with punctuation after it, goes
to the tokenizer's BPE model at once; any other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Chunks that the cache holds before it starts anew.
CACHE = 500_000
#: A longer chunk is encoded each time.
LONGEST = 64

#: Letters that NFC leaves alone and that have one lower case each, then punctuation other than the apostrophe.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-Þà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PROBE = ["Word", "word.", "ÉTÉ,", "a", "straße;", "naïve--", "x)", "Über!!", "mañana$$$"]


def _byte_letters() -> dict[int, str]:
    """The printable character that a byte-level model uses for each byte: the byte's own where it is printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        #: Whether the short way gives what the whole tokenizer gives.
        self.short = all(self._short(w) == self._whole(w) for w in _PROBE)

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, part: str) -> bytes:
        out = self.words.get(part)
        if out is None:
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            out = self.words[part] = np.array([t.id for t in tokens], "<u4").tobytes()
        return out

    def _short(self, chunk: str) -> bytes:
        m = _WORD.fullmatch(chunk)
        if not m:
            return self._whole(chunk)
        return self._model(m[1].lower()) + (self._model(m[2]) if m[2] else b"")

    def encode(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        cache = self.cache
        missing = {c for c in chunks if c not in cache}
        own = {}
        if missing:
            if len(cache) > CACHE:
                cache.clear()
                self.words.clear()
                cache[""] = b""
                missing = set(chunks) - {""}
            for c in missing:
                ids = self._short(c) if self.short and len(c) <= LONGEST else self._whole(c)
                (cache if len(c) <= LONGEST else own)[c] = ids
        if own:
            return b"".join([cache[c] if c in cache else own[c] for c in chunks])
        return b"".join([cache[c] for c in chunks])
