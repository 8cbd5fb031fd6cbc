"""The monitoring run: slices, injected drift, scores, two reports, a verdict."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.drift import (
    drift_scores,
    drift_status,
    drift_summary,
    inject_categorical,
    inject_numeric,
    monitoring_features,
    report_columns,
)
from ..operators.evaluation import classification_metrics
from ..operators.profile import categorical_profile, numeric_profile, union_all
from ..operators.split import monitoring_slices
from ..session import materialize


@dataclass
class MonitoringResult:
    summary: DataFrame
    status: DataFrame
    quality: DataFrame
    performance: DataFrame | None
    categories: DataFrame | None = None


def quality_comparison(slices: Mapping[str, DataFrame], numeric: list[str]) -> DataFrame:
    """Numeric profiles of the slices, one below the other."""
    return union_all([numeric_profile(df, numeric).withColumn("slice", F.lit(name)) for name, df in slices.items()])


def category_comparison(slices: Mapping[str, DataFrame], categorical: list[str]) -> DataFrame:
    return union_all([categorical_profile(df, categorical).withColumn("slice", F.lit(name)) for name, df in slices.items()])


def performance_by_slice(slices: Mapping[str, DataFrame], target: str, prediction: str = "prediction") -> DataFrame:
    """Metrics per slice, from one aggregation over the tagged rows."""
    tagged = union_all(
        [
            df.select(F.lit(name).alias("slice"), F.col(target).cast("int").alias("label"), F.col(prediction).alias("prediction"))
            for name, df in slices.items()
        ]
    )
    return classification_metrics(tagged, ["slice"])


def moves(settings: Mapping[str, Any]) -> tuple[dict[str, float], dict[str, float]]:
    """(factors, shifts) per column; the three named settings stand for their columns."""
    factors, shifts = dict(settings.get("numeric_multiply") or {}), dict(settings.get("numeric_shift") or {})
    if "amount_drift_multiplier" in settings:
        factors.setdefault("TransactionAmt", float(settings["amount_drift_multiplier"]))
    if "transaction_dt_shift" in settings:
        shifts.setdefault("TransactionDT", float(settings["transaction_dt_shift"]))
    if "card1_shift" in settings:
        shifts.setdefault("card1", float(settings["card1_shift"]))
    return factors, shifts


def inject_drift(
    df: DataFrame, key: str, settings: Mapping[str, Any], seed: int, numeric: list[str], categorical: list[str], hit: Column | None = None
) -> DataFrame:
    factors, shifts = moves(settings)
    moved = inject_numeric(df, settings.get("drifted_numeric_columns") or numeric, factors, shifts)
    return inject_categorical(
        moved, settings.get("drifted_categorical_columns") or categorical, key,
        float(settings.get("categorical_drift_fraction", 0.75)), settings.get("categorical_replacements"), seed, hit,
    )


def run_monitoring(
    df: DataFrame,
    key: str,
    target: str,
    settings: Mapping[str, Any],
    numeric: list[str],
    categorical: list[str],
    model: Transformer | None = None,
    in_reference: Column | None = None,
    drifted_rows: Column | None = None,
) -> MonitoringResult:
    """Compare a reference slice with a clean and with a drifted current slice.

    Slices are drawn by the key, ``sample_size`` rows each (null: all rows). A caller may give the rule instead: ``in_reference`` deals every
    row to one of the two (null: neither), and ``drifted_rows`` says which rows of the drifted one get replaced categories.
    """
    seed = int(settings.get("random_state", 42))
    size = settings.get("sample_size", 5000)
    if in_reference is not None:
        dealt = df.withColumn("slice", F.when(in_reference, "reference").when(~in_reference, "current")).where("slice IS NOT NULL")
    else:
        dealt = monitoring_slices(df, key, int(size) if size is not None else -(-df.count() // 2), seed)
    sliced = materialize(dealt)
    reference = sliced.where("slice = 'reference'").drop("slice")
    clean = sliced.where("slice = 'current'").drop("slice")
    drifted = inject_drift(clean, key, settings, seed, numeric, categorical, drifted_rows)
    slices = {"reference": reference, "clean_current": clean, "drifted_current": drifted}
    if model is not None:
        # Each slice has a bounded number of rows, so keeping its predictions is cheap.
        slices = {n: materialize(model.transform(d).select(*d.columns, F.col("prediction").cast("int").alias("prediction")))
                  for n, d in slices.items()}
    limit = int(settings.get("max_report_features", 20))
    numbers, texts = monitoring_features(reference, numeric, categorical, [target, key], limit)
    kept = report_columns(list(slices.values()), numbers, texts, target, key, model is not None)
    slices = {n: d.select(*kept) for n, d in slices.items()}
    numbers, texts = [c for c in numbers if c in kept], [c for c in texts if c in kept]
    labels = [c for c in (target, "prediction") if c in kept]
    summaries, states = [], []
    for report, name in (("baseline", "clean_current"), ("drift", "drifted_current")):
        scores = drift_scores(slices["reference"], slices[name], numbers, texts + labels)
        summary = drift_summary(materialize(scores)).withColumn("report", F.lit(report))
        summaries.append(summary)
        states.append(drift_status(summary, report, float(settings.get("drift_alert_share_threshold", 0.20))))
    performance = performance_by_slice(slices, target) if "prediction" in kept else None
    categories = category_comparison(slices, texts) if texts else None
    return MonitoringResult(union_all(summaries), union_all(states), quality_comparison(slices, numbers), performance, categories)
