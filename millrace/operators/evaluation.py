"""Evaluation of binary scores: confusion, curves, areas, gates, subgroups.

Scores are first counted per distinct value and class, so ties collapse and
every curve statistic is a sum of terms local to one row of running totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add_all
from ..session import materialize_counted
from .joins import sized
from .ordered import TASK_ROWS, running_totals

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")
THRESHOLD_METRICS = ("accuracy", "precision", "recall", "f1", "f2")

# Names a scoring metric goes by.
SCORING_ALIASES = {
    "accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1", "f1_score": "f1", "f2": "f2",
    "f2_score": "f2", "roc_auc": "roc_auc", "average_precision": "average_precision",
}


def metric_name(configured: str) -> str:
    try:
        return SCORING_ALIASES[configured]
    except KeyError:
        raise ValueError(f"unsupported scoring metric: {configured}") from None


def ratio(top: Column, bottom: Column) -> Column:
    """Division with 0/0 (and x/0) as 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion_sums(label: str = "label", prediction: str = "prediction") -> list[Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return [
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    ]


def rate_columns() -> dict[str, Column]:
    """Metrics of the positive class from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "f2": ratio(5 * tp, 5 * tp + fp + 4 * fn),
    }


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    counted = df.groupBy(*by).agg(*confusion_sums(label, prediction))
    return counted.select(*by, *[c.alias(n) for n, c in rate_columns().items()])


def subgroup_metrics(df: DataFrame, by: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows, positive rate, precision, recall and F1 per category."""
    counted = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate"),
        *confusion_sums(label, prediction),
    )
    rates = rate_columns()
    return counted.select(by, "n", "positive_rate", *[rates[m].alias(m) for m in ("precision", "recall", "f1")])


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support, and accuracy."""
    c = df.agg(*confusion_sums(label, prediction)).first()
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    div = lambda a, b: a / b if b else 0.0
    rows = []
    for name, hit, wrong, missed in (("0", tn, fn, fp), ("1", tp, fp, fn)):
        rows.append((name, div(hit, hit + wrong), div(hit, hit + missed), div(2 * hit, 2 * hit + wrong + missed), hit + missed))
    n = tp + fp + fn + tn
    rows = [r for r in rows if r[4] or r[1] or r[2]]
    macro = [sum(r[i] for r in rows) / max(len(rows), 1) for i in (1, 2, 3)]
    weighted = [div(sum(r[i] * r[4] for r in rows), n) for i in (1, 2, 3)]
    accuracy = div(tp + tn, n)
    table = rows + [("accuracy", accuracy, accuracy, accuracy, n), ("macro avg", *macro, n), ("weighted avg", *weighted, n)]
    return df.sparkSession.createDataFrame(table, "label string, precision double, recall double, f1 double, support bigint")


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label).cast("bigint")
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )


def cumulative_confusion(
    df: DataFrame, label: str = "label", score: str = "score", task_rows: int = TASK_ROWS
) -> DataFrame:
    """``score, pos, neg, tp, fp, positives, negatives`` by falling score."""
    counts, rows = materialize_counted(score_counts(df, label, score))
    totals = counts.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")).first()
    ranked = running_totals(counts, [], "score", ["pos", "neg"], descending=True, task_rows=task_rows, rows=rows)
    return ranked.select(
        "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        *[F.lit(totals[name]).cast("bigint").alias(name) for name in ("positives", "negatives")],
    )


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rate at every threshold."""
    steps = cumulative_confusion(df, label, score)
    return steps.select(
        F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tp"), F.col("positives")).alias("tpr"),
    )


def pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    steps = cumulative_confusion(df, label, score)
    return steps.select(
        F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )


def areas(df: DataFrame, label: str = "label", score: str = "score", task_rows: int = TASK_ROWS) -> DataFrame:
    """One row: ROC AUC (trapezoid over tied scores) and average precision (step sum).

    Both are NULL unless both classes occur.
    """
    steps = cumulative_confusion(df, label, score, task_rows)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    size = F.max("positives").cast("double") * F.max("negatives")
    auc = F.try_divide(F.sum(neg * (tp - pos / 2)), size)
    ap = F.try_divide(F.sum(pos * tp / (tp + fp)), F.max("positives").cast("double"))
    return steps.agg(auc.alias("roc_auc"), F.when(auc.isNotNull(), ap).alias("average_precision"))


def apply_threshold(df: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    cut = 0.5 if threshold is None else float(threshold)
    return df.withColumn("prediction", (F.col(score) >= F.lit(cut)).cast("int"))


def evaluate(df: DataFrame, threshold: float | None = None, label: str = "label", score: str = "score") -> dict[str, float | None]:
    """All metrics of a scored table at a threshold, over two scans."""
    row = classification_metrics(apply_threshold(df, threshold, score), label=label).first().asDict()
    return {**row, **areas(df, label, score).first().asDict(), "decision_threshold": 0.5 if threshold is None else threshold}


def candidates(grid: Sequence[float]) -> list[float]:
    return sorted({float(t) for t in grid if 0 < float(t) < 1})


def threshold_sweep(df: DataFrame, grid: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """Every metric at every candidate threshold, in one scan.

    A row is counted once, in the band between two candidates. The confusion
    table of a candidate is the sum over the bands above it: a window over as
    many rows as there are candidates.
    """
    cuts = candidates(grid)
    y = F.col(label).cast("bigint")
    band = add_all([(F.col(score) >= F.lit(t)).cast("int") for t in cuts])
    counted = df.where(F.col(score).isNotNull()).groupBy(band.alias("band")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    steps = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate([None, *cuts])], "band int, threshold double")
    every = Window.partitionBy(F.lit(0))
    above = every.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos, neg = F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0))
    table = steps.join(F.broadcast(counted), "band", "left").select(
        "threshold", F.sum(pos).over(above).alias("tp"), F.sum(neg).over(above).alias("fp"),
        F.sum(pos).over(every).alias("positives"), F.sum(neg).over(every).alias("negatives"),
    )
    table = table.where(F.col("threshold").isNotNull()).select(
        "threshold", "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), (F.col("negatives") - F.col("fp")).alias("tn")
    )
    return table.select("threshold", *[c.alias(n) for n, c in rate_columns().items()])


def select_threshold(df: DataFrame, grid: Sequence[float], metric: str = "f1", label: str = "label", score: str = "score") -> tuple[float | None, float]:
    """The lowest candidate with the best metric, and that metric."""
    metric = metric_name(metric)
    if metric not in THRESHOLD_METRICS:
        raise ValueError(f"unsupported threshold metric: {metric}")
    if not candidates(grid):
        return None, float("nan")
    best = threshold_sweep(df, grid, label, score).orderBy(F.desc(metric), "threshold").limit(1).first()
    return (best["threshold"], best[metric]) if best else (None, float("nan"))


def metric_failures(metrics: DataFrame, limits: Mapping[str, Any]) -> DataFrame:
    """``metric, actual, minimum`` of every limit that is not reached or has no value.

    ``metrics`` holds ``metric, value`` rows.
    """
    wanted = [(m, float(limits[f"min_{m}"])) for m in METRICS if f"min_{m}" in limits]
    table = metrics.sparkSession.createDataFrame(wanted, "metric string, minimum double")
    found = table.join(sized(metrics, len(METRICS)), "metric", "left")
    return found.where(F.col("value").isNull() | (F.col("value") < F.col("minimum"))).select(
        "metric", F.col("value").alias("actual"), "minimum"
    )


def melt_metrics(row: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of metrics to ``metric, value`` rows, missing ones skipped."""
    present = [n for n in names if n in row.columns]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in present])
    tidy = row.select(F.explode(pairs).alias("t")).select("t.*")
    return tidy.where(F.col("value").isNotNull() & ~F.isnan("value"))


def stored_metrics(results: DataFrame) -> DataFrame:
    """Metrics of the first row of a stored comparison table."""
    first = results.limit(1)
    if first.isEmpty():
        raise ValueError("the comparison table is empty")
    return melt_metrics(first, METRICS)
