"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 64-bit key: the upper half is a hash of the text, the lower half one of the id and the row's number, so equal texts
lie side by side and even a group of copies, or of repeated rows, of any size can be cut. Splitters are found by counting: each round counts the exact
bytes and rows below some candidate keys over all partitions and narrows each splitter's interval, until its bytes are within
tolerance. Rows are then exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .common import pieces_for

LOW, HIGH = -(2**63), 2**63


def sort_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The ordering key: a hash of the text above a hash of the id and the row's number, which has to be written with the row."""
    upper = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(text)), 32), 32)
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.monotonically_increasing_id()), 32))


def counts_below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each of the sorted probes, and in all (last). One small row a probe and task
    is combined; the driver gets one row a probe."""
    cuts = np.array(probes, np.int64)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(cuts, batch.column(0).to_numpy(), side="right")
            np.add.at(size, at, batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], ["bin", "bytes", "n"])

    found = keys.select("key", "size").mapInArrow(histogram, "bin long, bytes long, n long").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    size, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
    for r in found.collect():
        size[r["bin"]], rows[r["bin"]] = r["bytes"], r["n"]
    return np.cumsum(size), np.cumsum(rows)


def splitters(keys: DataFrame, parts: int, shards: int, tolerance: float = 0.001, loose: float = 0.2, probes: int = 4096) -> list[int]:
    """The ``parts - 1`` keys that cut the rows into parts of near-equal bytes. Every ``parts // shards``-th cut bounds a shard and is
    within ``tolerance`` of a shard's bytes; the others, which only deal out the work, within ``loose`` of a part's bytes.
    A cut ends early where one key alone is heavier than that (one very long text)."""
    (total,), _ = counts_below(keys, [])
    targets = [total * i // parts for i in range(1, parts)]
    slack = [tolerance * total / shards if i % (parts // shards) == 0 else loose * total / parts for i in range(1, parts)]
    span = [[LOW, 0, HIGH, int(total)] for _ in targets]  # keys and bytes below, at either end
    found: list[int | None] = [None] * len(targets)
    while open_ := [i for i, cut in enumerate(found) if cut is None]:
        each, candidates = max(3, probes // len(open_)), set()
        for i in open_:
            low, below, high, above = span[i]
            middle = low + int((high - low) * ((targets[i] - below) / max(above - below, 1)))
            width = max(1, (high - low) // each)
            candidates.update(range(low + width, high, width))
            candidates.update(x for s in range(4, 64, 4) for x in (middle - ((high - low) >> s), middle + ((high - low) >> s)))
        tried = sorted(x for x in candidates if LOW < x < HIGH)
        below, _ = counts_below(keys, tried)
        for i in open_:
            j = int(np.searchsorted(below[:-1], targets[i]))  # the first probe with at least the target below
            for k in (j - 1, j):
                if 0 <= k < len(tried):
                    side = 0 if below[k] < targets[i] else 2
                    if span[i][0] < tried[k] < span[i][2]:
                        span[i][side : side + 2] = [tried[k], int(below[k])]
            low, least, high, most = span[i]
            cut = low if targets[i] - least < most - targets[i] and low > LOW else high
            if min(targets[i] - least, most - targets[i]) <= slack[i] or high - low <= 1:
                found[i] = min(cut, HIGH - 1)
    return sorted(c for c in found if c is not None)


def assign_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.001, part_rows: int = 500_000) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus one (null text: 1). Shards differ in bytes by ``tolerance`` of a shard at most, plus the
    heaviest row. Repeated rows are dealt one by one, null ids like others. Slots count from 0 within a shard
    in key order. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    raw = F.coalesce(F.col(text), F.lit(""))
    keys = scratch.save(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        sort_key(doc_id, text).alias("key"),
    ))
    each = max(pieces_for(keys.count(), part_rows * shards), 4)
    cuts = splitters(keys, shards * each, shards, tolerance)
    _, rows = counts_below(keys, cuts)
    # shard bounds are every each-th cut; where heavy keys made cuts meet, the part goes by the last of them
    first = [0, *rows[:-1].tolist()]
    offsets = [first[p] - first[p - p % each] for p in range(shards * each)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.array(cuts, np.int64)
        for batch in batches:
            part = np.searchsorted(cut, batch.column(3).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((part // each).astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.array(offsets, np.int64)[part])],
                [*batch.schema.names, "shard", "part", "before"],
            )

    kind = keys.schema["doc_id"].dataType.simpleString()
    dealt = keys.mapInArrow(deal, f"doc_id {kind}, size long, text_crc32 long, key long, shard int, part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id"))
    return dealt.repartition(shards * each, "part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + place - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
