"""Words and shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_digest = xxhash.xxh3_64_digest


class WordTable:
    """Numbers of a text's words, lower-cased in A-Z: runs of bytes other than ASCII white space.

    ``encode`` gives ``width`` big-endian unsigned 64-bit numbers for a word. Words are remembered;
    ``most`` bounds the memory."""

    def __init__(self, encode, width: int = 1, most: int = 400_000, longest: int = 48) -> None:
        self._encode, self._width = encode, width
        self._known: dict[bytes, bytes] = {}
        self._most, self._longest = most, longest

    def forget(self) -> None:
        self._known.clear()

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = text.lower().split(), self._known
        try:
            packed = b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self._most:
                known.clear()
            rare = {}
            for word in set(words):
                if word not in known:
                    (known if len(word) <= self._longest else rare)[word] = self._encode(word)
            packed = b"".join([known[w] if w in known else rare[w] for w in words])
        found = np.frombuffer(packed, ">u8").astype(np.uint64)
        return found if self._width == 1 else found.reshape(-1, self._width)


#: One for each Python worker.
word_hashes = WordTable(_digest)


def at_rest() -> None:
    """Give memory back at the end of a task: workers stay, and the next stage may need it."""
    word_hashes.forget()
    pa.default_memory_pool().release_unused()

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words, in order."""
    n = len(hashes) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        factor = _MIX
        for i in range(length):
            total += hashes[i : i + n] * factor
            factor = factor * _MIX + np.uint64(2)
            factor |= np.uint64(1)
    return mixed(total)


def shingle_set(text: bytes, length: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words; of the whole sequence where it is
    shorter; empty without words."""
    with np.errstate(over="ignore"):
        hashes = word_hashes(text)
        return np.unique(runs(hashes, min(length, len(hashes)))) if len(hashes) else hashes
