"""Word shingles of whole texts as 64-bit hashes, by array operations on batches.

Words are runs of bytes other than the ASCII blanks (9 to 13 and 32), with A-Z in
lower case. A word's hash is a polynomial of its bytes and a shingle's one of its
words' hashes, each followed by a mixing step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

WORDS = 5
#: Bytes of text that are hashed at once (a longer text alone).
CHUNK = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    found = np.full(size, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = 1 << (len(data) + 1).bit_length()
    powers, inverses = _powers(int(_P), size), _powers(int(_P_INVERSE), size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingles(texts: Sequence[bytes | None], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` arrays of the distinct shingles of each text, in order of both.

    A text of fewer words has its whole sequence as the one shingle; a text without
    words, an empty text and null have none."""
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    hashes = _word_hashes(data, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n = len(hashes)
    found_owner, found = [], []
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total = total * _Q + hashes[j : n - width + 1 + j]
        whole = owner[: n - width + 1] == owner[width - 1 :]
        found_owner.append(owner[: n - width + 1][whole])
        found.append(mixed(total[whole] + np.uint64(width)))
    counts = np.bincount(owner, minlength=len(texts))
    for text in np.flatnonzero((counts > 0) & (counts < width)):
        first = int(np.searchsorted(owner, text))
        total = np.zeros(1, np.uint64)
        for h in hashes[first : first + counts[text]]:
            total = total * _Q + h
        found_owner.append(np.array([text]))
        found.append(mixed(total + np.uint64(counts[text])))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner, hashes = np.concatenate(found_owner), np.concatenate(found)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]
