"""Joins. Nothing is broadcast unless its row count is known and small.

Beyond the bound a plain shuffle join is planned; a hot key is then split by
adaptive skew-join handling, which cuts the hot side along its map outputs and
so copes even with rows that are equal in every column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import value_text
from ..session import materialize, materialize_counted

# A broadcast side holds at most this many rows and bytes of key text.
BROADCAST_ROWS = 1_000_000
BROADCAST_TEXT = 64 * 1024 * 1024


def left_join_optional(fact: DataFrame, side: DataFrame | None, key: str) -> DataFrame:
    """Left equi join; without a side table, the fact table as it is."""
    return fact if side is None else fact.join(side, key, "left")


def sized(df: DataFrame, rows: int, text_bytes: int = 0) -> DataFrame:
    """Mark a side for broadcast when its known size is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and text_bytes <= BROADCAST_TEXT else df


def within_budget(sizes: Mapping[str, Sequence[int]]) -> set[str]:
    """Which of several tables, given as (rows, text bytes), may be broadcast together."""
    chosen, rows, text = set(), 0, 0
    for name, (n, b) in sorted(sizes.items(), key=lambda item: (item[1][0], item[0])):
        if rows + n <= BROADCAST_ROWS and text + b <= BROADCAST_TEXT:
            chosen.add(name)
            rows, text = rows + n, text + b
    return chosen


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: str,
    defaults: Mapping[str, Any],
) -> DataFrame:
    """Dictionary lookup with a default per looked-up column; ``table`` has one row per key. It is written once, and its rows
    and text are counted before it may be broadcast."""
    saved = materialize(table)
    texts = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in saved.schema.fields if f.dataType.typeName() == "string"]
    seen = saved.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0)).alias("b")).first()
    found = df.join(sized(saved, seen["n"], seen["b"]), on, "left")
    return found.select(
        *df.columns,
        *[(F.coalesce(F.col(c), F.lit(d)) if d is not None else F.col(c)).alias(c) for c, d in defaults.items()],
    )


def category_shares(df: DataFrame, column: str, keep_missing: bool = False) -> DataFrame:
    """``value, n, share``: the total comes from the counts, not from a second scan."""
    text = value_text(df, column)
    values = df.select(text.alias("value"))
    if not keep_missing:
        values = values.where(F.col("value").isNotNull())
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("total")).scalar()
    return counts.select("value", "n", (F.col("n").cast("double") / total).alias("share"))


def align_distributions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full alignment of two share tables on the value; an absent value has share 0."""
    a = left.select("value", F.col("share").alias("p"))
    b = right.select("value", F.col("share").alias("q"))
    return a.join(b, "value", "full_outer").select(
        "value", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")
    )


def anti_categories(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Values seen but not known. Both sides hold distinct values."""
    return observed.select("value").distinct().join(known.select("value").distinct(), "value", "left_anti")


def top_n_alignment(reference: DataFrame, current: DataFrame, column: str, n: int) -> DataFrame:
    """The reference's most frequent values in percent, with the current percent beside them."""
    top = category_shares(reference, column).orderBy(F.desc("n"), "value").limit(n)
    now = category_shares(current, column).select("value", F.col("share").alias("now"))
    return top.join(now, "value", "left").select(
        "value",
        (F.col("share") * 100).alias("reference_pct"),
        (F.coalesce("now", F.lit(0.0)) * 100).alias("current_pct"),
    )


def category_sets(reference: DataFrame, current: DataFrame, column: str, keep: int = 25) -> DataFrame:
    """Values of either side, flagged; new ones are ranked and the first ``keep`` marked."""
    sides = [
        df.select(value_text(df, column).alias("value")).where(F.col("value").isNotNull()).distinct()
        for df in (reference, current)
    ]
    union = sides[0].union(sides[1]).distinct()
    fresh = sides[1].subtract(sides[0])
    listed = fresh.orderBy("value").limit(keep).select("value", F.lit(True).alias("listed"))
    return (
        union.join(fresh.select("value", F.lit(True).alias("fresh")), "value", "left")
        .join(listed, "value", "left")
        .select(
            "value",
            F.coalesce("fresh", F.lit(False)).alias("is_new"),
            F.coalesce("listed", F.lit(False)).alias("is_listed"),
        )
    )


# Keys of more columns than this are looked for by fingerprints first.
NARROW_KEY = 4


def fingerprint(columns: Sequence[Column]) -> list[Column]:
    """128 bits of some columns as two longs. NULLs count as such, wherever they stand."""
    given = [part for c in columns for part in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *given) for seed in (0x5EED, 0x1DEA)]


def possible_duplicates(df: DataFrame, keys: Sequence[str], prints: Callable[[Sequence[Column]], list[Column]] = fingerprint) -> tuple[DataFrame, int]:
    """(rows whose fingerprint over the keys occurs more than once, number of all rows). Only fingerprints are counted, 16 bytes a row
    combined before the shuffle; equal rows always are among those returned, and the few others that share a fingerprint by chance."""
    marked = df.select("*", *[c.alias(f"_print{i}") for i, c in enumerate(prints([F.col(f"`{k}`") for k in keys]))])
    names = [c for c in marked.columns if c not in df.columns]
    counted = materialize(marked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    repeated, many = materialize_counted(counted.where("_n > 1").select(*names))
    found = marked.join(sized(repeated, many, 16 * many), names, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
    return found, counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def count_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their counts (map-side combined)."""
    if len(keys) > NARROW_KEY:
        df, _ = possible_duplicates(df, keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_members(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once; NULL keys are equal to each other.

    Counts are combined before the shuffle and joined back, so no task has to
    buffer all copies of one key. Of wide keys, only rows with a repeated fingerprint are counted and joined.
    """
    if len(keys) > NARROW_KEY:
        df, _ = possible_duplicates(df, keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*[F.col(k).alias(f"_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(repeated, condition, "left_semi")
