from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import evaluation


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.2).astype(int)
    s = np.where(rng.random(600) < 0.34, 0.5, (rng.random(600) * 0.6 + 0.4 * y).round(2))
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double").cache()


def test_golden(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.8), (1, 0.7), (0, 0.2)], "label int, score double")
    found = evaluation.evaluate(df)
    assert found["f1"] == 1.0 and found["roc_auc"] == 1.0 and found["average_precision"] == 1.0 and found["decision_threshold"] == 0.5


@pytest.mark.parametrize("task_rows", [10**6, 0])
def test_areas_equal_brute_force(scored, task_rows):
    data = scored.toPandas()
    pos, neg = data[data.label == 1].score.to_numpy(), data[data.label == 0].score.to_numpy()
    gap = pos[:, None] - neg[None, :]
    auc = ((gap > 0) + 0.5 * (gap == 0)).mean()
    ap, before = 0.0, 0.0
    for t in sorted(data.score.unique(), reverse=True):
        tp, n = (pos >= t).sum(), (data.score >= t).sum()
        ap, before = ap + (tp / len(pos) - before) * tp / n, tp / len(pos)
    row = evaluation.areas(scored, task_rows=task_rows).first()
    assert row["roc_auc"] == pytest.approx(auc) and row["average_precision"] == pytest.approx(ap)


def test_one_class_has_no_areas(scored):
    row = evaluation.areas(scored.where("label = 1")).first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    row = evaluation.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_threshold_choice(scored):
    grid = [0.9, 0.1, 0.5, 0.5, 0.0, 1.0]
    sweep = {r["threshold"]: r["f1"] for r in evaluation.threshold_sweep(scored, grid).collect()}
    assert sorted(sweep) == [0.1, 0.5, 0.9]
    threshold, best = evaluation.select_threshold(scored, grid, "f1_score")
    assert best == max(sweep.values()) and sweep[threshold] == best
    data = scored.toPandas()
    hit = data.score >= 0.5
    tp = (hit & (data.label == 1)).sum()
    assert sweep[0.5] == pytest.approx(2 * tp / (hit.sum() + data.label.sum()))
    assert evaluation.select_threshold(scored, [], "f1")[0] is None
    with pytest.raises(ValueError):
        evaluation.select_threshold(scored, grid, "roc_auc")
    with pytest.raises(ValueError):
        evaluation.metric_name("mcc")


def test_first_threshold_wins_ties(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.2)], "label int, score double")
    assert evaluation.select_threshold(df, [0.7, 0.3, 0.5])[0] == 0.3


def test_gate(spark):
    metrics = spark.createDataFrame([("f1", 0.5), ("recall", 0.9)], "metric string, value double")
    limits = {"min_f1": 0.6, "min_recall": 0.4, "min_roc_auc": 0.8, "other": 1}
    found = {r["metric"]: (r["actual"], r["minimum"]) for r in evaluation.metric_failures(metrics, limits).collect()}
    assert found == {"f1": (0.5, 0.6), "roc_auc": (None, 0.8)}


def test_stored_metrics(spark):
    table = spark.createDataFrame([("m", "r1", 0.9, None)], "model string, run_id string, f1 double, roc_auc double")
    assert [(r["metric"], r["value"]) for r in evaluation.stored_metrics(table).collect()] == [("f1", 0.9)]
    with pytest.raises(ValueError):
        evaluation.stored_metrics(table.limit(0))


def test_report(spark):
    df = spark.createDataFrame([(0, 0)] * 8 + [(1, 1)] * 3 + [(1, 0), (0, 1)], "label int, prediction int")
    rows = {r["label"]: r for r in evaluation.classification_report(df).collect()}
    assert rows["1"]["precision"] == 0.75 and rows["1"]["support"] == 4 and rows["0"]["recall"] == pytest.approx(8 / 9)
    assert rows["accuracy"]["f1"] == pytest.approx(11 / 13)
