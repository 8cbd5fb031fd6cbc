"""Words that lie in long repeated passages, found by recompression.

A text is a row of word names (64-bit hashes). A round names runs of equal neighbours and pairs of a left-class and a right-class
neighbour, where a hash of the name and the round decides the class. Names are hashes of what they stand for, so every task names equal things
alike without a dictionary, and equal passages get equal names everywhere but near their ends: a name depends on the words
of its own and of two neighbours on either side in each round, and that span of words is carried along: some 20 words after
three rounds. Wherever the span's words recur, the name recurs. A name that occurs once in the whole corpus therefore
rules out all windows that hold its span; only what is left is compared, window by window, by 96 bits: of two hashes of its words, which
are taken from XXH64 with two seeds and so do not collide together.

Both checks work alike: tasks hold groups of documents and send each distinct hash once, in blocks by hash range;
a range answers each group with those of its hashes that another group has, too. Hot passages thus cost one entry a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import mix, powers
from .exchange import cuts, scaled
from .words import text_hashes

ROUNDS = 3
_PAIR, _RUN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BASES = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))


def compress_round(names: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
    """One round over the names of one document. start/end: the words a name stands for; low/high: the words it depends on
    (-1 or beyond the end where it depends on where the document ends)."""
    n = len(names)
    side = mix(names ^ np.uint64(turn + 1)) & np.uint64(1)
    same = names[1:] == names[:-1]
    pair = (side[:-1] == 0) & (side[1:] == 1) & ~same
    if same.any():  # a name inside a run takes part in no pair
        in_run = np.zeros(n, bool)
        in_run[1:] |= same
        in_run[:-1] |= same
        pair &= ~in_run[1:] & ~in_run[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~(same | pair))))
    last = np.concatenate((first[1:], [n])) - 1
    length = last - first + 1
    paired = np.zeros(len(first), bool)
    paired[length == 2] = pair[first[length == 2]]
    name = names[first].copy()
    name[paired] = mix(mix(names[first[paired]] ^ _PAIR) + names[last[paired]] * np.uint64(3))
    run = (length > 1) & ~paired
    name[run] = mix(mix(names[first[run]] ^ _RUN) + length[run].astype(np.uint64))
    left, right = first - 2, last + 2  # an end depends on two neighbours: the next one could lie in a run
    below = np.where(left >= 0, low[np.maximum(left, 0)], -1)
    above = np.where(right < n, high[np.minimum(right, n - 1)], np.iinfo(np.int64).max)
    return name, start[first], end[last], np.minimum(below, low[first]), np.maximum(above, high[last])


def symbols(words: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names after all rounds, with the first word each depends on and the one after the last."""
    at = np.arange(len(words), dtype=np.int64)
    state = (words, at, at + 1, at, at + 1)
    for turn in range(rounds):
        state = compress_round(*state, turn)
    return state[0], state[3], state[4]


def windows(words: np.ndarray, others: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window of so many words, 64 and 32 bits, from two hashes of each word."""
    n, out = len(words) - window + 1, []
    for base, value in zip(_BASES, (words, others)):
        inverse = np.uint64(pow(int(base), -1, 2**64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * powers(base, len(words)))))
        out.append(mix((sums[window:] - sums[:-window]) * powers(inverse, n)))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def possible(words: np.ndarray, window: int, is_single: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Per window start: no name that occurs only once has its span inside the window."""
    n = len(words) - window + 1
    name, low, high = symbols(words)
    inner = (low >= 0) & (high <= len(words)) & (high - low <= window)
    inner[inner] = is_single(name[inner])
    begin, stop = np.maximum(high[inner] - window, 0), np.minimum(low[inner], n - 1)
    some = begin <= stop
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin[some], 1)
    np.add.at(change, stop[some] + 1, -1)
    return np.cumsum(change[:-1]) == 0


def blocks(group: int, hashes: np.ndarray, extra: np.ndarray | None, ranges: int) -> pd.DataFrame:
    """The distinct hashes of a group as one row a hash range that has some, so at most one a hash: the sorted hashes, their extra
    hashes, and which came twice."""
    if extra is None:
        value, n = np.unique(hashes, return_counts=True)
        more = np.empty(0, np.uint32)
    else:
        order = np.lexsort((extra, hashes))
        hashes, extra = hashes[order], extra[order]
        head = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (extra[1:] != extra[:-1])))) if len(hashes) else np.empty(0, np.int64)
        value, more, n = hashes[head], extra[head], np.diff(np.append(head, len(hashes)))
    rows = [(r, group, value[a:b].tobytes(), more[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for r, a, b in cuts(scaled(value, ranges))]
    return pd.DataFrame(rows, columns=["range", "grp", "hashes", "extra", "twice"])


BLOCKS = "range int, grp int, hashes binary, extra binary, twice binary"


def repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """For one hash range: to every group, its hashes that come twice in it or also in another group."""
    hashes = [np.frombuffer(b, np.uint64) for b in rows["hashes"]]
    size = [len(h) for h in hashes]
    value, owner = np.concatenate(hashes), np.repeat(np.arange(len(rows)), size)
    extra = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["extra"]])
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for b, k in zip(rows["twice"], size)])
    order = np.argsort(value, kind="stable") if not len(extra) else np.lexsort((extra, value))
    value, owner, twice = value[order], owner[order], twice[order]
    equal = value[1:] == value[:-1]
    if len(extra):
        equal &= extra[order][1:] == extra[order][:-1]
    hit = twice.copy()
    hit[1:] |= equal
    hit[:-1] |= equal
    extra = extra[order][hit] if len(extra) else extra
    value, owner = value[hit], owner[hit]
    back = np.argsort(owner, kind="stable")
    value, cut = value[back], np.searchsorted(owner[back], np.arange(len(rows) + 1))
    extra = extra[back] if len(extra) else extra
    out = [(int(g), value[a:b].tobytes(), extra[a:b].tobytes()) for g, a, b in zip(rows["grp"], cut[:-1], cut[1:]) if a < b]
    return pd.DataFrame(out, columns=["grp", "hashes", "extra"])


def _answers(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of all replies, and their extra hashes where they have some."""
    value = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(b, np.uint64) for b in replies["hashes"]]])
    extra = np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(b, np.uint32) for b in replies["extra"]]])
    order = np.lexsort((extra, value)) if len(extra) else np.argsort(value)
    return value[order], extra[order] if len(extra) else extra


def _isin(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _both_in(known: tuple[np.ndarray, np.ndarray], value: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Which pairs of hashes are known: the entries with an equal first hash are tried one after the other."""
    hit, at = np.zeros(len(value), bool), np.searchsorted(known[0], value)
    todo = np.arange(len(value))
    while len(todo := todo[at[todo] < len(known[0])]) and len(todo := todo[known[0][at[todo]] == value[todo]]):
        hit[todo] = known[1][at[todo]] == extra[todo]
        todo = todo[~hit[todo]]
        at[todo] += 1
    return hit


def name_step(docs: pd.DataFrame, window: int, ranges: int) -> pd.DataFrame:
    names = [np.empty(0, np.uint64)]
    for words in text_hashes(docs["text"]):
        if len(words) >= window:
            name, low, high = symbols(words)
            names.append(name[(low >= 0) & (high <= len(words)) & (high - low <= window)])
    return blocks(int(docs["grp"].iloc[0]), np.concatenate(names), None, ranges)


def window_step(docs: pd.DataFrame, replies: pd.DataFrame, window: int, ranges: int) -> pd.DataFrame:
    if not len(docs):
        return blocks(0, np.empty(0, np.uint64), None, ranges)
    (known, _), first, second = _answers(replies), [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for words, others in zip(text_hashes(docs["text"]), text_hashes(docs["text"], 1)):
        if len(words) >= window:
            maybe = possible(words, window, lambda x: ~_isin(known, x))
            if maybe.any():
                a, b = windows(words, others, window)
                first.append(a[maybe])
                second.append(b[maybe])
    return blocks(int(docs["grp"].iloc[0]), np.concatenate(first), np.concatenate(second), ranges)


def cover_step(docs: pd.DataFrame, replies: pd.DataFrame, window: int, with_text: bool) -> pd.DataFrame:
    known, out = _answers(replies), []
    for row, text, first, second in zip(docs["row"], docs["text"], text_hashes(docs["text"]), text_hashes(docs["text"], 1)):
        words = (text or "").encode().split()
        kept, gone = words, 0
        if len(words) >= window and len(known[0]):
            hit = np.flatnonzero(_both_in(known, *windows(first, second, window)))
            if len(hit):
                change = np.zeros(len(words) + 1, np.int64)
                change[hit] = 1
                np.subtract.at(change, hit + window, 1)
                stay = np.cumsum(change[:-1]) == 0
                kept, gone = list(compress(words, stay.tolist())), int(len(words) - stay.sum())
        text = b" ".join(kept)
        out.append((row, len(words), gone, hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(
    docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, group_bytes: int = 12_000_000, range_bytes: int = 8_000_000,
    written: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and kept_text on request.

    A word goes when a window of ``window`` words that covers it has the same words as a window that starts
    anywhere else. Null texts have no words; texts shorter than a window lose none; of repeated long
    rows each loses all. Other columns are not read; an empty table gives no rows. Rows are dealt to groups by their number, so they have to come in
    a fixed order: pass ``written`` for a table read from files; any other frame is written once. Every group holds about ``group_bytes`` of text and every hash range about ``range_bytes`` of hashes, so tasks stay small at any size.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").cast("string").alias("row"), F.col(text).alias("text"))
    rows = rows if written else scratch.save(rows)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, ranges = max(1, -(-size // group_bytes)), max(1, -(-2 * size // range_bytes))
    rows = rows.select("row", "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("grp"))

    def answers(sent: DataFrame) -> DataFrame:
        return scratch.save(sent.groupBy("range").applyInPandas(repeated, "grp int, hashes binary, extra binary"))

    named = answers(rows.groupBy("grp").applyInPandas(lambda d: name_step(d, window, ranges), BLOCKS))
    scratch.free()
    seen = answers(rows.groupBy("grp").cogroup(named.groupBy("grp")).applyInPandas(lambda d, r: window_step(d, r, window, ranges), BLOCKS))
    scratch.free(named)
    out = rows.groupBy("grp").cogroup(seen.groupBy("grp")).applyInPandas(
        lambda d, r: cover_step(d, r, window, with_text), "doc_id string, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *out.columns[1:4], *(["kept_text"] if with_text else []))
