"""Words of texts as XXH64 hashes, taken for all words at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

from .common import SPACES

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
# fixed values of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class Stream:
    """Bytes of many words, and features as (start, length) in it."""

    def __init__(self, data: np.ndarray) -> None:
        self.bytes = np.concatenate((data, np.zeros(8, np.uint8)))
        self._eights = np.ndarray(len(data) + 1, "<u8", self.bytes, strides=(1,))

    def load(self, at: np.ndarray, width: np.ndarray | int = 8) -> np.ndarray:
        """Up to eight bytes from each position, as a little-endian number."""
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(width, 8).astype(np.uint64)) if isinstance(width, np.ndarray) else np.uint64(64 - 8 * width)
        return (self._eights[at] << unused) >> unused

    def hashes(self, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
        """XXH64 of every feature: below 32 bytes for all at once, longer ones one by one."""
        h = np.uint64(seed) + _P5 + length.astype(np.uint64)
        for at in (0, 8, 16):
            some = np.flatnonzero(length >= at + 8)
            h[some] = _rotate(h[some] ^ (_rotate(self.load(start[some] + at) * _P2, 31) * _P1), 27) * _P1 + _P4
        done = length & ~7
        some = np.flatnonzero(length & 4)
        h[some] = _rotate(h[some] ^ (self.load(start[some] + done[some], 4) * _P1), 23) * _P2 + _P3
        done = length & ~3
        for at in range(3):
            some = np.flatnonzero(length & 3 > at)
            h[some] = _rotate(h[some] ^ (self.bytes[start[some] + done[some] + at].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(length >= 32).tolist():
            h[i] = xxhash.xxh64_intdigest(self.feature(start[i], length[i]), seed)
        return h

    def feature(self, start: int, length: int) -> memoryview:
        return self.bytes[start : start + length].data

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes of two features of equal length are the same."""
        same, todo = np.ones(len(a), bool), np.arange(len(a))
        for at in range(0, 64, 8):
            todo = todo[length[todo] > at]
            same[todo] &= self.load(a[todo] + at, length[todo] - at) == self.load(b[todo] + at, length[todo] - at)
        for i in todo[length[todo] > 64].tolist():
            same[i] = same[i] and self.feature(a[i], length[i]) == self.feature(b[i], length[i])
        return same


BLOCK = 4_000_000  # bytes of text hashed together


def flat_hashes(texts: Sequence[str | None], seeds: Sequence[int] = (0,), lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """XXH64 of the words of all texts, one array a seed, and the number of words of each text. Words are runs of bytes other than ASCII
    white space. Texts are taken together in blocks, as most are short; A-Z turn into small letters on request."""
    found: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in seeds]
    words: list[np.ndarray] = [np.empty(0, np.int64)]
    held, size = [], 0

    def take() -> None:
        raw = b" ".join([*held, b""])
        data = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        inside = np.concatenate(([False], ~_IS_SPACE[data]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        begin, length = turns[::2], turns[1::2] - turns[::2]
        stream = Stream(data)
        for out, seed in zip(found, seeds):
            out.append(stream.hashes(begin, length, seed))
        words.append(np.diff(np.searchsorted(begin, np.cumsum([len(t) + 1 for t in held])), prepend=0))

    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size > BLOCK:
            take()
            held, size = [], 0
    if held:
        take()
    return [np.concatenate(out) for out in found], np.concatenate(words)


def text_hashes(texts: Sequence[str | None], seed: int = 0) -> list[np.ndarray]:
    """The word hashes of every text."""
    (flat,), words = flat_hashes(texts, (seed,))
    return np.split(flat, np.cumsum(words)[:-1]) if len(words) else []
