"""Near-duplicates by SimHash fingerprints, found with vantage-point trees.

A bounded sample of fingerprints gives a top tree: each node has a vantage fingerprint and a radius r. Fingerprints at
distance <= r+1 go to the inner side, those at distance >= r to the outer side, and the shell in between to both. By the
triangle inequality two fingerprints that differ in at most 2 bits differ by at most 2 in their distance to the
vantage, so at every node they share a side, and in the end a shard. A shard searches the same way in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .components import components

RADIUS = 2


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the shingles of a text: a bit is 1 if it is set in over half of their hashes. No word: zero."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    whole, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts, hashed, view = [0, *ends[:-1]], xxhash.xxh64_intdigest, memoryview(whole)
    step = min(words, len(parts)) - 1
    hashes = np.array([hashed(view[starts[i] : ends[i + step] - 1], 42) for i in range(n)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _marks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "print"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, print): one row a document, the fingerprint as a signed long. Null text has no word."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: _marks(batches, words), "doc_id long, print long")


class Tree:
    """Vantage points over a sample of fingerprints; ``shards`` says where each fingerprint has to go."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._root = self._grow(sample, depth)

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        split = best_split(sample) if depth else None
        if split is None:
            self.leaves += 1
            self.nodes.append((self.leaves - 1,))
        else:
            vantage, r = split
            d = np.bitwise_count(sample ^ vantage)
            inner, outer = self._grow(sample[d <= r + 1], depth - 1), self._grow(sample[d >= r], depth - 1)
            self.nodes.append((vantage, r, inner, outer))
        return len(self.nodes) - 1

    def shards(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, position in ``prints``) of every copy that is sent."""
        out, todo = [], [(self._root, np.arange(len(prints)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out.append((np.full(len(rows), node[0]), rows))
                continue
            d = np.bitwise_count(prints[rows] ^ node[0])
            todo += [(node[2], rows[d <= node[1] + 1]), (node[3], rows[d >= node[1]])]
        return np.concatenate([s for s, _ in out]), np.concatenate([r for _, r in out])


def best_split(prints: np.ndarray, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage and radius with the smallest larger side, or None if no split takes off a twentieth of the rows."""
    if len(prints) < 16:
        return None
    best = None
    for vantage in prints[:: max(1, len(prints) // tries)][:tries]:
        counts = np.bincount(np.bitwise_count(prints ^ vantage), minlength=67)
        below = np.concatenate(([0], np.cumsum(counts)))  # below[r]: rows at a distance under r
        sides = np.maximum(below[2:66], len(prints) - below[:64])  # for r: d <= r+1, and d >= r
        r = int(np.argmin(sides))
        if best is None or sides[r] < best[0]:
            best = (sides[r], vantage, r)
    return (best[1], best[2]) if best[0] <= 0.95 * len(prints) else None


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (up := label[label] != label).any():
            label[up] = label[label[up]]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def link(prints: np.ndarray, radius: int = RADIUS, leaf: int = 1024, block: int = 256) -> np.ndarray:
    """For sorted distinct fingerprints, the position of the smallest one reachable over links inside this set."""
    assert radius == RADIUS, "sides overlap by a shell of two distances, made for links of two bits"
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held, todo = 0, [np.arange(len(prints))]
    while todo:
        rows = todo.pop()
        split = best_split(prints[rows]) if len(rows) > leaf else None
        if split is not None:
            d = np.bitwise_count(prints[rows] ^ split[0])
            todo += [rows[d <= split[1] + 1], rows[d >= split[1]]]
            continue
        for at in range(0, len(rows), block):
            some = rows[at : at + block]
            i, j = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[rows[at:]][None, :]) <= radius)
            a, b = some[i], rows[at:][j]
            pairs.append((a[a != b], b[a != b]))
            held += len(pairs[-1][0])
            if held > 4_000_000:  # keep what the pairs say, not the pairs
                root = _merge(len(prints), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
                tied = np.flatnonzero(root != np.arange(len(prints)))
                pairs, held = [(tied, root[tied])], len(tied)
    none = np.empty(0, np.int64)
    return _merge(len(prints), np.concatenate([none, *[p[0] for p in pairs]]), np.concatenate([none, *[p[1] for p in pairs]]))


def _link_shard(rows: pd.DataFrame) -> pd.DataFrame:
    prints = np.unique(rows["print"].to_numpy(np.int64).view(np.uint64))
    root = link(prints)
    tied = np.flatnonzero(root != np.arange(len(prints)))
    return pd.DataFrame({"a": prints[root[tied]].view(np.int64), "b": prints[tied].view(np.int64)})


def links(reps: DataFrame, rows: int, shard_rows: int = 16_384, leaves: int = 4096) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints that differ in at most two bits: per shard, each
    fingerprint with the smallest one of its component there. The top tree has at most ``leaves`` leaves, made from a sample of
    32 fingerprints a leaf; larger shards are split on in memory."""
    spark = reps.sparkSession
    depth = min(math.ceil(math.log(max(rows / shard_rows, 1)) / math.log(1 / 0.6)), int(math.log2(leaves)))
    drawn = reps.orderBy(F.xxhash64(F.col("print"), F.lit(1)), "print").limit(32 * 2**depth).collect() if depth else []
    tree = Tree(np.array([r["print"] for r in drawn], np.int64).view(np.uint64), depth)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            shard, at = tree.shards(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(prints[at])], ["shard", "print"])

    sent = reps.select("print").mapInArrow(send, "shard int, print long")
    return sent.groupBy("shard").applyInPandas(_link_shard, "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Null and empty texts have fingerprint zero, linked like any other. Repeated rows each give a row; null ids are
    passed over when the smallest is sought. Copies meet as one fingerprint before any comparison.
    """
    scratch = Scratch(docs.sparkSession)
    marks = scratch.save(fingerprints(docs, doc_id, text, words))
    reps = scratch.save(marks.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(links(reps, reps.count()), scratch)
    rooted = scratch.save(reps.join(roots, reps["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "least"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("print", "component_id"))
    return marks.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
