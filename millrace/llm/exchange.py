"""Counts of keys over groups of rows, in compact messages.

A group sends each distinct key once, with its count, as one row an owner (a range of the keys); an owner adds up and answers
every group in the order of its question, so answers hold no keys. A group sends at most one row a key, however many owners there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def packed(count: np.ndarray) -> bytes:
    """Small numbers as bytes, the low ones of all first, so that the zeros behind compress."""
    return np.ascontiguousarray(count.astype("<u8").view(np.uint8).reshape(-1, 8).T[: _width(count)]).tobytes() + bytes([_width(count)])


def _width(count: np.ndarray) -> int:
    return max(1, -(-int(count.max(initial=0)).bit_length() // 8))


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[-1]
    out = np.zeros((8, (len(raw) - 1) // width), np.uint8)
    out[:width] = np.frombuffer(raw, np.uint8, len(raw) - 1).reshape(width, -1)
    return np.ascontiguousarray(out.T).view("<u8").ravel().astype(np.int64)


def cuts(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, from, to) of the runs of a sorted array; only owners that get something appear."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
    return list(zip(owner[first].tolist(), first.tolist(), np.append(first[1:], len(owner)).tolist()))


def scaled(ids: np.ndarray, owners: int) -> np.ndarray:
    return (((ids >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


QUESTIONS, REPLIES = "owner int, grp long, ids binary, counts binary", "grp long, owner int, counts binary"


def questions(grp: int, ids: np.ndarray, counts: np.ndarray, owners: int, bits: int = 64) -> pd.DataFrame:
    """The sorted distinct keys of a group, of so many bits, as steps from key to key."""
    wide = ids << np.uint64(64 - bits)
    rows = [(o, grp, packed(np.diff(ids[a:b], prepend=np.uint64(0))), packed(counts[a:b])) for o, a, b in cuts(scaled(wide, owners))]
    return pd.DataFrame(rows, columns=["owner", "grp", "ids", "counts"])


def replies(rows: pd.DataFrame) -> pd.DataFrame:
    """For one owner: to every group the sums over all groups of its keys' counts."""
    ids = [np.cumsum(unpacked(b).view(np.uint64), dtype=np.uint64) for b in rows["ids"]]
    value, place = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.zeros(len(value), np.int64)
    np.add.at(total, place, np.concatenate([unpacked(b) for b in rows["counts"]]))
    at = np.cumsum([0, *map(len, ids)])
    out = [(g, o, packed(total[place[a:b]])) for g, o, a, b in zip(rows["grp"], rows["owner"], at[:-1], at[1:])]
    return pd.DataFrame(out, columns=["grp", "owner", "counts"])


def read_replies(rows: pd.DataFrame) -> np.ndarray:
    """The sums of a group's keys, in their order."""
    return np.concatenate([np.empty(0, np.int64), *[unpacked(b) for b in rows.sort_values("owner")["counts"]]])
