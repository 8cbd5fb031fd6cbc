"""Shared pieces: white space, held-out rows, sizes, scrambling, CRC-32 in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the rows that no fit may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name the frame does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def pieces_for(rows: int, each: int) -> int:
    """Partitions so that each holds about ``each`` rows."""
    return max(1, -(-int(rows) // each))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT: dict[Any, Any] = {}


def kept(key: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker builds once and holds for its next tasks. Workers outlive stages, so a worker holds one such thing at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    """Lets go of what an earlier stage left in this worker."""
    _KEPT.clear()


def text_parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, a few at a time: as many as reach ``most`` bytes of text."""
    at, sizes = 0, pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    while at < len(batch):
        to = min(len(batch), int(np.searchsorted(ends, ends[at] - sizes[at] + most)) + 1)
        yield batch.slice(at, to - at)
        at = to


def powers(base: np.uint64, n: int, _known: dict = {}) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64; kept for the next call while short."""
    out = _known.get(base)
    if out is None or len(out) < n:
        out = np.full(max(n, 65_536), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if len(out) <= 4_194_304:
            _known[base] = out
    return out[:n]


CRC_TABLE_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_row)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes as DuckDB SQL, in a query over the one-row table ``crc_table`` (CRC_TABLE_SQL)."""
    digits = f"hex(encode({text}))"
    pairs = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr({digits}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({pairs}, lambda c, b: xor(c >> 8, crc_row[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
