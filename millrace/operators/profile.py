"""Descriptive aggregates: shares, profiles, missing rates, histograms, bins.

Per-column statistics of wide tables are built as one aggregate per chunk of
columns and turned into tidy rows, never as one job per column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import MISSING, finite, is_missing, numeric_columns, text_columns, to_number, value_text
from ..session import materialize
from .joins import category_shares
from .ordered import column_statistics, exact_quantiles, group_quantiles

AGGREGATE_CHUNK = 100
PROFILE_QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)
TOP_CATEGORIES = 100


def chunks(items: Sequence[Any], size: int = AGGREGATE_CHUNK) -> list[list[Any]]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def unpivot_text(df: DataFrame, columns: Sequence[str], keep_missing: bool = True) -> DataFrame:
    """``column, value`` rows of the text form of several columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value_text(df, c).alias("value")) for c in columns])
    tidy = df.select(F.explode(pairs).alias("pair")).select("pair.column", "pair.value")
    return tidy if keep_missing else tidy.where(F.col("value").isNotNull())


def value_shares(df: DataFrame, column: str) -> DataFrame:
    return category_shares(df, column)


def target_rate(df: DataFrame, column: str, target: str) -> DataFrame:
    """Rows and mean target (percent) per category."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(target) * 100).alias("rate_pct")
    )


def rate_with_support(df: DataFrame, column: str, target: str, minimum: int = 500) -> DataFrame:
    """Target rate of groups with enough rows, highest first."""
    return target_rate(df, column, target).where(F.col("n") >= minimum).orderBy(F.desc("rate_pct"), column)


def top_categories(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """The k most frequent values; ties go by value."""
    return category_shares(df, column).orderBy(F.desc("n"), "value").limit(k)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``column, n_distinct``. Exact counts dedupe (column, value) pairs before the
    shuffle, so a hot value is one row per task."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return melt(row, columns, "n_distinct", "bigint")
    pairs = unpivot_text(df, columns, keep_missing=False).distinct()
    found = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct")
    )


def melt(row: DataFrame, columns: Sequence[str], value: str, dtype: str = "double") -> DataFrame:
    """One wide row to tidy ``column, <value>`` rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(dtype).alias(value)) for c in columns])
    return row.select(F.explode(pairs).alias("pair")).select("pair.*")


def group_median(df: DataFrame, group: str, column: str) -> DataFrame:
    """Exact median per group, from (group, value) counts."""
    data = df.select(value_text(df, group).alias("value"), to_number(df, column).alias("_x"))
    data = data.where(F.col("value").isNotNull())
    return group_quantiles(data, ["value"], "_x", [0.5]).select("value", "n", F.col("quantiles")[0].alias("median"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing fraction, moments, extremes and quantiles per numeric column, in two scans for any number of columns.

    Infinite values are left out of the statistics but are not missing.
    """
    columns = [c for c in columns if c in df.columns]
    spark = df.sparkSession
    clean = df.select(
        *[finite(to_number(df, c)).alias(f"x{i}") for i, c in enumerate(columns)],
        *[to_number(df, c).isNull().cast("double").alias(f"m{i}") for i, c in enumerate(columns)],
    )
    # A missing flag is one more column of the same two scans; its mean is the missing fraction.
    found = column_statistics(clean, clean.columns, PROFILE_QUANTILES)
    rows = []
    for i, c in enumerate(columns):
        stats = found[f"x{i}"]
        keep = lambda v: round(float(v), 8) if v is not None else None
        rows.append((c, stats["n"], round(found[f"m{i}"]["mean"] or 0.0, 6), *[keep(stats[k]) for k in ("mean", "std", "min", "max")], *[keep(q) for q in stats["quantiles"]]))
    return spark.createDataFrame(
        rows,
        "column string, count bigint, missing_fraction double, mean double, std double, min double, max double, "
        "q01 double, q05 double, q50 double, q95 double, q99 double",
    )


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` with the missing token, for several columns in one scan."""
    tidy = unpivot_text(df, columns).select("column", F.coalesce("value", F.lit(MISSING)).alias("value"))
    return tidy.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_distribution(counts: DataFrame, totals: DataFrame, keep: int = TOP_CATEGORIES) -> DataFrame:
    """The ``keep`` most frequent values per column with their share of all rows.

    Rank filters on a window are pruned per task before the shuffle
    (WindowGroupLimit), so a column with many values does not travel whole.
    """
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("_rank", rank).where(F.col("_rank") <= keep)
    return top.join(F.broadcast(totals.select("column", "rows")), "column").select(
        "column", "value", F.round(F.col("n").cast("double") / F.col("rows"), 8).alias("share")
    )


def category_tables(df: DataFrame, columns: Sequence[str], keep: int = TOP_CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """(per-column summary, top distribution), both from one table of counts."""
    columns = [c for c in columns if c in df.columns]
    counts = materialize(category_counts(df, columns))
    summary = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value") != MISSING, F.col("n")).otherwise(0)).alias("count"),
        F.count_if(F.col("value") != MISSING).alias("unique_count"),
    )
    summary = summary.select(
        "column",
        "rows",
        "count",
        F.round(1 - F.col("count").cast("double") / F.col("rows"), 6).alias("missing_fraction"),
        "unique_count",
    )
    return summary, top_distribution(counts, summary, keep)


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary and top shares as one tidy table."""
    summary, shares = category_tables(df, columns)
    return shares.join(F.broadcast(summary.drop("rows")), "column")


def describe(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, whole or per group."""
    keys = [by] if by else []
    data = df.select(*keys, to_number(df, column).alias("_x"))
    moments = data.groupBy(*keys).agg(
        F.count("_x").alias("count"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    names, at = ("q25", "q50", "q75"), [0.25, 0.5, 0.75]
    if not keys:
        found = exact_quantiles(data, ["_x"], at)["_x"]
        return moments.select("*", *[F.lit(q).cast("double").alias(n) for n, q in zip(names, found)])
    quartiles = group_quantiles(data, keys, "_x", at)
    return moments.join(quartiles.select(*keys, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)]), keys)


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing percent per column, from one aggregate per chunk of columns."""
    columns = list(columns or df.columns)
    parts = []
    for part in chunks(columns):
        row = df.agg(*[(F.avg(is_missing(df, c).cast("double")) * 100).alias(c) for c in part])
        parts.append(melt(row, part, "missing_pct"))
    return union_all(parts)


def missing_rate_buckets(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of columns per range of missing percent."""
    rate = F.col("missing_pct")
    bucket = (
        F.when(rate <= 10, "0-10%").when(rate <= 30, "10-30%").when(rate <= 50, "30-50%").when(rate <= 70, "50-70%")
        .otherwise("70-100%")
    )
    return missing_by_column(df, columns).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_columns"))


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-adjusted skewness per column."""
    row = df.select(*[to_number(df, c).alias(c) for c in columns])
    adjusted = []
    for c in columns:
        n = F.count(c).cast("double")
        factor = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
        adjusted.append((F.skewness(c) * factor).alias(c))
    return melt(row.agg(*adjusted), columns, "skewness")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``left, right, corr``: Pearson correlation of every pair of columns, each over its complete rows, in one scan.

    A task holds, for all pairs at once, the rows that have both values, their means, squared deviations and products, and merges batch by
    batch; what tasks send is merged by column. NULL where a pair has fewer than two complete rows or a column does not vary in them.
    """
    columns = list(columns or numeric_columns(df))
    size = len(columns)
    data = df.select(*[to_number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    fields = "n array<double>, m array<double>, m2 array<double>, s array<double>, s2 array<double>, c array<double>"

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                state = merged(state, pair_moments(batch.iloc[at : at + 4096].to_numpy(float)))
        if state is not None:
            n, m, s, c = state
            yield pd.DataFrame({"i": range(size), "n": list(n), "m": list(m), "m2": list(m.T), "s": list(s), "s2": list(s.T), "c": list(c)})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        state = None
        for _, r in rows.iterrows():
            part = [np.stack([r["n"], r["n"]]), np.stack([r["m"], r["m2"]]), np.stack([r["s"], r["s2"]]), np.stack([r["c"], r["c"]])]
            state = merged(state, part, lambda d: d[::-1])
        i = int(rows["i"].iloc[0])
        n, (own, other), c = state[0][0], state[2], state[3][0]
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = np.where((n > 1) & (own > 0) & (other > 0), c / np.sqrt(own * other), np.nan)
        others = columns[i + 1 :]
        return pd.DataFrame({"left": pd.Series([columns[i]] * len(others), dtype=object), "right": pd.Series(others, dtype=object), "corr": corr[i + 1 :]})

    found = data.mapInPandas(gather, f"i int, {fields}").groupBy("i").applyInPandas(finish, "left string, right string, corr double")
    return found.withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))


def pair_moments(x: np.ndarray) -> list[np.ndarray]:
    """Of every pair (i, j) over the rows with both: their number, the mean and squared deviations of i, and the co-moment."""
    here = np.isfinite(x)
    one = here.astype(float)
    shift = np.where(here.any(axis=0), np.where(here, x, 0).sum(axis=0) / np.maximum(one.sum(axis=0), 1), 0)
    x = np.where(here, x - shift, 0)
    n, total = one.T @ one, x.T @ one
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, total / n, 0)
    return [n, mean + shift[:, None], (x**2).T @ one - n * mean**2, x.T @ x - n * mean * mean.T]


def merged(a: list[np.ndarray] | None, b: list[np.ndarray], turned: Callable[[np.ndarray], np.ndarray] = np.transpose) -> list[np.ndarray]:
    """The moments of two sets of rows together; ``turned`` gives (j, i) in the place of (i, j)."""
    if a is None:
        return b
    n = a[0] + b[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(n > 0, b[0] / n, 0)
    apart = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0)
    mean = np.where(a[0] > 0, a[1] + apart * share, b[1])
    return [n, mean, a[2] + b[2] + apart**2 * a[0] * share, a[3] + b[3] + apart * turned(apart) * a[0] * share]


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram; the maximum falls into the last bin."""
    data = df.select(finite(to_number(df, column)).alias("x")).where(F.col("x").isNotNull())
    edge = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        lo, hi = 0.0, 1.0
    width = (hi - lo) / bins or 1.0
    index = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = data.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left_edge"), "n")


def quantile_edges(df: DataFrame, column: str, q: int = 10) -> list[float]:
    data = df.select(finite(to_number(df, column)).alias("x"))
    found = exact_quantiles(data, ["x"], [i / q for i in range(q + 1)])["x"]
    return sorted({float(e) for e in found if e is not None})


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins over the edges, the first one closed on both sides; without edges, no bin."""
    if not edges:
        return F.lit(None).cast("int")
    index = F.when(value < edges[0], None)
    for i, right in enumerate(edges[1:]):
        index = index.when(value <= F.lit(right), F.lit(i))
    return index


def rate_by_quantile_bin(df: DataFrame, column: str, target: str, q: int = 10) -> DataFrame:
    """Target rate per quantile bin; equal edges are merged, so ties never straddle."""
    # Written once as two narrow columns: the quantiles scan it several times, and ``df`` may be a join.
    narrow = materialize(df.select(to_number(df, column).alias("_x"), F.col(target).alias("_y")))
    edges = quantile_edges(narrow, "_x", q)
    binned = narrow.select(bin_index(F.col("_x"), edges).alias("bin"), "_y")
    return binned.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("_y") * 100).alias("rate_pct")
    )


def overview(df: DataFrame) -> dict[str, int]:
    """Rows, columns and how many columns are numeric or not."""
    return {
        "rows": df.count(),
        "columns": len(df.columns),
        "numeric_columns": len(numeric_columns(df)),
        "other_columns": len(text_columns(df)),
    }


def available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def configured_columns(df: DataFrame, wanted: Sequence[str], numeric: bool) -> list[str]:
    """Configured columns that exist; by type when none do."""
    present = [c for c in wanted if c in df.columns]
    return present or (numeric_columns(df) if numeric else text_columns(df))


def column_types(df: DataFrame, categorical_like: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features; some numeric columns may be declared categorical."""
    numeric = [c for c in numeric_columns(df) if c not in set(categorical_like)]
    return numeric, [c for c in df.columns if c not in set(numeric)]


def feature_target(df: DataFrame, target: str, id_column: str | None = None) -> tuple[list[str], str]:
    """Names of the feature columns beside the target, which must exist."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    return [c for c in df.columns if c not in {target, id_column}], target


def feature_projection(df: DataFrame, target: str, id_column: str | None = None) -> DataFrame:
    return df.select(*feature_target(df, target, id_column)[0])


def profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str | None = None) -> dict[str, DataFrame]:
    """Baseline profile: column types, numeric stats, category summary and shares."""
    spark = df.sparkSession
    numeric = configured_columns(df, numeric, True)
    categorical = configured_columns(df, categorical, False)
    extra = [target] if target and target in df.columns and target not in categorical else []
    summary, shares = category_tables(df, [*categorical, *extra])
    role = lambda d: d.withColumn("role", F.when(F.col("column") == F.lit(target), "target").otherwise("feature"))
    types = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], T.StructType(
        [T.StructField("column", T.StringType()), T.StructField("dtype", T.StringType())]))
    return {
        "columns": types,
        "numeric": numeric_profile(df, numeric),
        "categorical": role(summary),
        "distribution": role(shares),
    }
