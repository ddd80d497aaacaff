"""Token ids of whole texts by the tokenizers library, with a bounded word cache.

A vocabulary that drops white space and cuts inside words only gives a text the
ids of its ASCII-blank separated chunks, one after the other. Few chunks are new,
so most ids come from a cache; new chunks go to the library: a plain word to its
merge model, anything else to its whole encoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Chunks and words a worker remembers, about 200 MB; older ones go by halves.
CACHE_CHUNKS, CACHE_WORDS = 500_000, 800_000

#: Latin-1 letters: composed, and lower case maps each to one such letter.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A run of such signs behind a word is encoded apart from it.
_SIGNS = b".,;:!?|*$%&#()[]{}=+-_/~^@"


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered:
    """A dictionary of at most twice ``half`` entries: when the young half is full
    it becomes the old one, and the entries of the old one that were not used go."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[key] = value


class WordEncoder:
    """Encodes texts (UTF-8 bytes) to ids as ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks = Remembered(CACHE_CHUNKS // 2)
        self.words = Remembered(CACHE_WORDS // 2)
        self.signs: dict[bytes, bytes] = {b"": b""}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        word = word.lower()
        data = word.encode()
        mapped = word if len(data) == len(word) else "".join([self.letters[b] for b in data])
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of a plain word with A-Z in lower case, None if it isn't plain."""
        ids = self.words.get(word)
        if ids is None:
            text = word.decode()
            if not _PLAIN.fullmatch(text):
                return None
            ids = self._word(text)
            if len(word) <= 60:
                self.words.put(word, ids)
        return ids

    def _sign(self, sign: bytes) -> bytes:
        ids = self.signs.get(sign)
        if ids is None:
            ids = self._whole(sign.decode())
            if len(self.signs) < 10_000:
                self.signs[sign] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk that is not among the young ones. ``words`` holds plain
        words only, with A-Z in lower case."""
        ids = self.chunks.old.get(chunk)
        if ids is None:
            word = chunk.rstrip(_SIGNS)
            ids = self._plain(word.lower()) if word else b""
            if ids is None:
                return self._whole(chunk.decode())
            ids += self._sign(chunk[len(word) :])
        if len(chunk) <= 60:
            self.chunks.put(chunk, ids)
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        young = self.chunks.young
        found = []
        for chunk in text.split():
            ids = young.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                young = self.chunks.young
            found.append(ids)
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this process; its cache outlives a task."""
    return WordEncoder(path)


def encoded(texts: Iterator[bytes | None], path: str) -> Iterator[bytes]:
    """Ids of each text; null counts as empty."""
    own = encoder(path)
    for text in texts:
        yield own.encode(text) if text else b""
