"""Exact deduplication with cuckoo-filter indexes over live digests.

Texts are equal when they are identical after deleting ASCII white space. Every row becomes a small key row (digest,
code points, id); a first set of indexes combines the rows of each input task, so that a group of copies of any size
leaves one row a task, and a second set, one a digest bucket, combines those. Both sets hold only live digests: a better
row takes the place of the row that stood for its digest (delete, then insert).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from .common import pieces_for


class CuckooIndex:
    """A cuckoo filter of 16-bit tags in front of live entries that lie in buckets.

    ``find`` asks the filter first; only a hit reads the bucket and compares whole digests, so a false hit costs time but
    never joins two texts. ``remove`` takes the tag and the entry out. When no place is found for a tag after ``KICKS``
    moves, the index doubles and is refilled from the stored digests.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024) -> None:
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self._mask = buckets - 1
        self._tags: list[list[int]] = [[] for _ in range(buckets)]
        self._live: list[list[list]] = [[] for _ in range(buckets)]
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def entries(self) -> Iterator[list]:
        for bucket in self._live:
            yield from bucket

    def _home(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "big") & self._mask, int.from_bytes(digest[8:10], "big") or 1

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self._mask

    def find(self, digest: bytes) -> list | None:
        home, tag = self._home(digest)
        if tag not in self._tags[home] and tag not in self._tags[self._other(home, tag)]:
            return None
        return next((entry for entry in self._live[home] if entry[0] == digest), None)

    def add(self, digest: bytes, *payload: object) -> None:
        home, tag = self._home(digest)
        self._live[home].append([digest, *payload])
        self.size += 1
        if not self._add_tag(home, tag):
            self._grow()

    def _add_tag(self, bucket: int, tag: int) -> bool:
        for place in (bucket, self._other(bucket, tag)):
            if len(self._tags[place]) < self.SLOTS:
                self._tags[place].append(tag)
                return True
        for step in range(self.KICKS):
            slots, slot = self._tags[bucket], (tag + step) % self.SLOTS
            tag, slots[slot] = slots[slot], tag
            bucket = self._other(bucket, tag)
            if len(self._tags[bucket]) < self.SLOTS:
                self._tags[bucket].append(tag)
                return True
        return False

    def _grow(self) -> None:
        stored = list(self.entries())
        self._clear(2 * (self._mask + 1))
        for entry in stored:
            self.add(*entry)

    def remove(self, digest: bytes) -> bool:
        home, tag = self._home(digest)
        entry = self.find(digest)
        if entry is None:
            return False
        self._live[home].remove(entry)
        self.size -= 1
        for place in (home, self._other(home, tag)):
            if tag in self._tags[place]:
                self._tags[place].remove(tag)
                return True
        return True


KEYS = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("n_points", T.LongType()),
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
])
_ARROW = pa.schema([("digest", pa.binary()), ("n_points", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = [(digest, -best[0], None if best[1] else best[2], best[3], n) for digest, best, n in index.entries()]
    for at in range(0, len(rows), 50_000):
        columns = zip(*rows[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def combine(batches: Iterator[pa.RecordBatch], live: int | None = None) -> Iterator[pa.RecordBatch]:
    """One row a digest: the best row's fields and the number of rows. With ``live``, an index that has grown to so many
    digests is handed on and a new one begun, which bounds memory; what is handed on twice is combined later."""
    index = CuckooIndex()
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(f.name)).to_pylist() for f in _ARROW]
        for digest, points, doc_id, row, n in zip(*columns):
            best = (-points, doc_id is None, doc_id if doc_id is not None else 0, row)
            entry = index.find(digest)
            if entry is None:
                index.add(digest, best, n)
                if live and len(index) >= live:
                    yield from _emit(index)
                    index = CuckooIndex()
            elif best < entry[1]:
                index.remove(digest)
                index.add(digest, best, entry[2] + n)
            else:
                entry[2] += n
    yield from _emit(index)


def with_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``digest`` (of the text without white space; null is empty), ``n_points`` and a row number."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({
        "digest": F.unhex(F.sha2(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", ""), 256)),
        "n_points": F.length(whole).cast("long"),
        "row": F.monotonically_increasing_id(),
    })


def survivors(keys: DataFrame, scratch: Scratch, live: int = 200_000) -> DataFrame:
    """One row a digest from written key rows: keep_row, keep_id, group_size."""
    rows = keys.select("digest", "n_points", F.col("doc_id").cast("long").alias("doc_id"), "row", F.lit(1).cast("long").alias("n"))
    part = scratch.save(rows.mapInArrow(lambda batches: combine(batches, live), KEYS))
    return (
        part.repartition(pieces_for(part.count(), live), "digest").mapInArrow(combine, KEYS)
        .select("digest", F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the most code points stays, then the smallest doc_id (null last), then any one of rows
    that are equal in both. Null text counts as empty; an empty table gives no rows; other columns are not read. Only
    key rows are shuffled, texts never.
    """
    scratch = Scratch(docs.sparkSession)
    keys = scratch.save(with_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    return keys.join(survivors(keys, scratch), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows are written once with their keys, as a row number must not change
    between the decision and the filter."""
    scratch = Scratch(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    saved = scratch.save(with_keys(held).drop("text"))
    stay = survivors(saved.select("digest", "n_points", "doc_id", "row"), scratch).select(F.col("keep_row").alias("row"))
    return saved.join(stay, "row", "left_semi").select("held.*")
