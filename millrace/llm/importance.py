"""Importance resampling towards a target distribution of word n-grams.

Features are runs of words, hashed into buckets. A bucket's gain is the logarithm of how much likelier it is in the target
than in the corpus; a document's weight is the sum of its features' gains, and with Gumbel noise from a hash of its id the
highest scores are a weighted draw without replacement.

Both passes over a text intern its features per block in an open-addressed table of NumPy arrays: XXH64 keys give the first
slot, equal keys are verified byte by byte, and other features move on to the next slot. A slot holds a feature's bucket and count, so
a bucket is computed once a distinct feature; every occurrence remembers its slot, and gathers the gain from there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import CRC_TABLE_SQL, crc32_sql, pieces_for
from .words import Stream

BLOCK = 4_000_000  # bytes of text whose features are interned together
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalnum() else 32 for c in bytes(range(128)).lower()]
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


class Slots:
    """An open-addressed table of the distinct features of a block: first occurrence, bucket and count a slot.
    ``of`` is the slot of every occurrence."""

    def __init__(self, stream: Stream, start: np.ndarray, length: np.ndarray, buckets: int, keys: np.ndarray | None = None) -> None:
        keys = stream.hashes(start, length) if keys is None else keys
        size = 1 << max(4, int(2 * len(start)).bit_length())
        first, self.of = np.full(size, -1, np.int64), np.empty(len(start), np.int64)
        at, todo = (keys & np.uint64(size - 1)).astype(np.int64), np.arange(len(start))
        while len(todo):
            place = at[todo]
            free = first[place] < 0
            first[place[free]] = todo[free]
            holder = first[place]
            same = (keys[holder] == keys[todo]) & (length[holder] == length[todo])
            check = np.flatnonzero(same & (holder != todo))
            same[check] = stream.equal(start[holder[check]], start[todo[check]], length[todo[check]])
            self.of[todo[same]] = place[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & (size - 1)
        self.used = np.flatnonzero(first >= 0)
        self.count, self.bucket = np.bincount(self.of, minlength=size), np.zeros(size, np.int64)
        holder = first[self.used]
        self.bucket[self.used] = [zlib.crc32(stream.feature(s, n)) % buckets for s, n in zip(start[holder].tolist(), length[holder].tolist())]


def blocks(texts: list[str | None], words: int, limit: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Parts (position of the text, bytes, words at its head that an earlier part has counted) of some ``limit`` bytes in all. A
    longer text is cut between words, and a part repeats the ``words - 1`` words before it, so no run of words is lost."""
    held, size = [], 0
    for i, text in enumerate(texts):
        raw, at, carry = (text or "").encode(), 0, b""
        while at < len(raw):
            cut = _BREAK.search(raw, at + limit) if len(raw) - at > limit else None
            end = cut.start() + 1 if cut else len(raw)
            part = carry + raw[at:end]
            if size and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append((i, part, len(carry.split())))
            size += len(part)
            if words > 1 and end < len(raw):
                tail = [w for w in _BREAK.split(part) if w][1 - words :]
                carry = b"".join(w + b" " for w in tail)
            at = end
    if held:
        yield held


def features(parts: list[tuple[int, bytes, int]], words: int) -> tuple[Stream, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of 1 to ``words`` words of the parts: the byte stream, starts, lengths, part numbers, and the part of every new word."""
    data = _FOLD[np.frombuffer(b"".join(p + b" " for _, p, _ in parts), np.uint8)]
    inside = np.concatenate(([False], data != 32))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = turns[::2], turns[1::2]
    part = np.searchsorted(np.cumsum([len(p) + 1 for _, p, _ in parts]), begin, side="right")
    keep = inside[1:] | inside[:-1]  # words, each with one blank behind it
    start = np.concatenate((np.zeros(1, np.int64), np.cumsum(end - begin + 1)))[:-1]
    stop = start + (end - begin)
    place = np.arange(len(part)) - np.searchsorted(part, part)  # of a word in its part
    new = place >= np.array([n for _, _, n in parts], np.int64)[part]
    runs = []
    for n in range(1, words + 1):
        last = np.flatnonzero(new & (place >= n - 1))
        runs.append((start[last - n + 1], stop[last] - start[last - n + 1], part[last]))
    return Stream(data[keep]), *(np.concatenate(c) for c in zip(*runs)), part[new]


def bucket_counts(texts: DataFrame, words: int, buckets: int) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket. A task sends a row a bucket, which are summed; the driver gets one
    row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for parts in blocks(batch.column(0).to_pylist(), words, BLOCK):
                stream, start, length, _, _ = features(parts, words)
                slots = Slots(stream, start, length, buckets)
                np.add.at(total, slots.bucket[slots.used], slots.count[slots.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of every bucket."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, words: int) -> DataFrame:
    """The rows (doc_id, text) as (doc_id, n_words, n_features, weight)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for parts in blocks(batch.column(1).to_pylist(), words, BLOCK):
                stream, start, length, part, word_part = features(parts, words)
                slots = Slots(stream, start, length, len(gain))
                row = np.array([i for i, _, _ in parts], np.int64)
                by_slot = gain[slots.bucket]
                np.add.at(out[0], row[word_part], 1)
                np.add.at(out[1], row[part], 1)
                np.add.at(out[2], row[part], by_slot[slots.of])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column], limit: int, scratch: Scratch, part_rows: int) -> DataFrame:
    """``rows`` with a column rank: 1, 2, 3... of the first ``limit`` rows in this order, then by their number, null for the others.
    Rows are range partitioned and sorted once; a row's rank is its place in its part and the exact count of the parts before."""
    spark, order = rows.sparkSession, [*order, F.col("number")]
    sorted_ = rows.repartitionByRange(pieces_for(rows.count(), part_rows), *order).sortWithinPartitions(*order)
    placed = scratch.save(sorted_.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("place", 33)))
    before, at = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").agg(F.count(F.lit(1))).collect()):
        before.append((part, at))
        at += n
    rank = F.col("before") + F.col("place").bitwiseAND(2**33 - 1) + 1
    return placed.join(spark.createDataFrame(before, "part long, before long"), "part").withColumn("rank", F.when(rank <= limit, rank)).select(*rows.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, words: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024",
    doc_id: str = "doc_id", text: str = "text", part_rows: int = 500_000,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank, drawn towards the texts of ``target`` (its column ``text``).

    Null and empty texts have no feature and weight 0. Repeated rows count and are ranked one by one; ties go to the smaller id,
    null ids last (their noise is that of an empty id). Of the rows with at least ``min_words`` words ``percent`` percent, rounded down, have a rank.
    Other columns are not read; empty tables give no rows, an empty target leaves smoothed shares. The driver holds one
    number a bucket, so its memory is bounded by ``buckets``, and one number a part of ``part_rows`` rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    gain = gains(bucket_counts(rows, words, buckets), bucket_counts(target.select(F.col("text").cast("string").alias("text")), words, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = scratch.save(weighed(rows, gain, words).withColumn("score", score.cast("long")).withColumn("number", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= min_words
    fit = scored.where(enough)
    drawn = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id")], percent * fit.count() // 100, scratch, part_rows)
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def resample_sql(buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024") -> str:
    """The SQL of ``resample`` over single words."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS n, doc_id, {words} AS words FROM documents),
f AS (SELECT n, unnest(words) AS w FROM d), g AS (SELECT unnest({words}) AS w FROM benchmark),
v AS (SELECT w, {crc32_sql("w")} % {buckets} AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc_table),
s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN v USING (w) GROUP BY bucket),
b AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + {buckets})
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {buckets})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
x AS (SELECT n, sum(gain) AS weight FROM f JOIN v USING (w) JOIN b USING (bucket) GROUP BY n),
y AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
  (CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (n)),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id NULLS LAST) AS place,
  {percent} * count(*) OVER (PARTITION BY n_features >= {min_words}) // 100 AS drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {min_words} AND place <= drawn THEN place END AS rank FROM z"""
