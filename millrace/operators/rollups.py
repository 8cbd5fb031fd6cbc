"""Serving rollups over an event table: counts, histograms, windowed rates.

Every rollup is a partial-combining aggregate, so a hot label or window only
costs one row per task in the shuffle. The same functions run on streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import group_quantiles

WINDOW = "5 minutes"
WINDOW_SECONDS = 300.0

# Upper bounds of the serving histograms.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
PROBABILITY_BOUNDS = [0.0, 0.01, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9, 1.0]
CONFIDENCE_BOUNDS = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
MISSING_BOUNDS = [0, 1, 5, 10, 25, 50, 100, 200, 432, 600]
GAUGE_METRICS = [
    "accuracy", "precision", "recall", "f1", "f2", "roc_auc", "average_precision", "decision_threshold",
]


def event_counts(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def cumulative_histogram(events: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by..., le, count`` for each upper bound and +Inf, with the sum and total count."""
    x = F.col(value)
    counted = events.groupBy(*by).agg(
        *[F.count_if(x <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(x).alias("total"),
        F.sum(x).alias("value_sum"),
    )
    tidy = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("count")),
    )
    return counted.select(*by, F.explode(tidy).alias("t"), "value_sum", "total").select(*by, "t.le", "t.count", "value_sum", "total")


def windows(ts: str = "ts", size: str = WINDOW, slide: str | None = None) -> Column:
    return F.window(ts, size, slide) if slide else F.window(ts, size)


def windowed_rate(
    events: DataFrame, by: Sequence[str] = (), ts: str = "ts", size: str = WINDOW, seconds: float = WINDOW_SECONDS,
    slide: str | None = None,
) -> DataFrame:
    """Events per second and window, in total or per label."""
    counted = events.groupBy(windows(ts, size, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("w.start").alias("window_start"), *by, "n", (F.col("n").cast("double") / F.lit(seconds)).alias("per_second")
    )


def windowed_quantiles(
    events: DataFrame, value: str, probabilities: Sequence[float] = (0.5, 0.95), by: Sequence[str] = (), ts: str = "ts",
    size: str = WINDOW, approximate: bool = False,
) -> DataFrame:
    """Latency quantiles per window (and label): exact, or by a mergeable sketch."""
    data = events.select(windows(ts, size)["start"].alias("window_start"), *by, F.col(value).cast("double").alias("_x"))
    names = [f"p{round(p * 100)}" for p in probabilities]
    if approximate:
        found = data.groupBy("window_start", *by).agg(
            F.count("_x").alias("n"), F.percentile_approx("_x", [float(p) for p in probabilities], 10000).alias("quantiles")
        )
    else:
        found = group_quantiles(data, ["window_start", *by], "_x", probabilities)
    return found.select("window_start", *by, "n", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])


def bucket_quantile(histogram: DataFrame, probability: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile estimated from cumulative buckets by interpolation inside the bucket.

    At most one row per bound and label, so the buckets of a label fit an array.
    """
    rows = histogram.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("le", "count"))).alias("b"), F.max("count").alias("total")
    )
    rank = F.col("total") * F.lit(float(probability))
    at = F.array_position(F.transform("b", lambda x: (x["count"] >= rank).cast("int")), 1).cast("int")
    hit = F.try_element_at("b", F.when(at > 0, at))
    before = F.when(at > 1, F.try_element_at("b", F.when(at > 1, at - 1)))
    low = F.when(at > 1, before["le"]).otherwise(F.least(F.lit(0.0), hit["le"]))
    below = F.when(at > 1, before["count"]).otherwise(F.lit(0))
    inside = low + (hit["le"] - low) * F.try_divide(rank - below, (hit["count"] - below).cast("double"))
    # In the open last bucket the estimate is its lower bound.
    return rows.select(*by, F.when(hit["le"] == float("inf"), low).otherwise(F.coalesce(inside, low)).alias("estimate"))


def windowed_means(events: DataFrame, values: Sequence[str], ts: str = "ts", size: str = WINDOW) -> DataFrame:
    return events.groupBy(windows(ts, size).alias("w")).agg(*[F.avg(v).alias(f"mean_{v}") for v in values]).select(
        F.col("w.start").alias("window_start"), *[f"mean_{v}" for v in values]
    )


def evaluation_gauges(results: DataFrame) -> DataFrame:
    """``model, metric, value`` of the first row of the comparison table, NULLs skipped."""
    first = results.limit(1)
    present = [m for m in GAUGE_METRICS if m in first.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in present])
    tidy = first.select("model", F.explode(pairs).alias("t")).select("model", "t.metric", "t.value")
    return tidy.where(F.col("value").isNotNull() & ~F.isnan("value"))
