"""Queries over evaluation, scoring, serving rollups and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, rollups, scoring, training
from ..operators.quality import build_suite
from ..session import materialize, scratch_path
from ..sources.fixtures import scores, table
from ..streaming import jobs
from .catalog import query, rounded

CUT = 0.9


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("label", F.col("is_fraud"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.apply_threshold(labelled(spark, sf_dir), CUT)


# -- evaluation -----------------------------------------------------------------------------


@query(
    "confusion_matrix",
    "SELECT is_fraud AS label, CASE WHEN score >= 0.9 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM scored GROUP BY 1, 2",
    "scored",
)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(predicted(spark, sf_dir))


def _counts(where="score >= 0.9"):
    return f"""count(*) FILTER (WHERE is_fraud = 1 AND {where}) AS tp, count(*) FILTER (WHERE is_fraud = 0 AND {where}) AS fp,
      count(*) FILTER (WHERE is_fraud = 1 AND NOT {where}) AS fn, count(*) FILTER (WHERE is_fraud = 0 AND NOT {where}) AS tn"""


_RATES = """round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1,
  round(coalesce(5 * tp / nullif(5 * tp + fp + 4 * fn, 0), 0), 8) AS f2"""
RATES = ("accuracy", "precision", "recall", "f1", "f2")


@query("classification_metrics", f", c AS (SELECT {_counts()} FROM scored) SELECT {_RATES} FROM c", "scored")
def classification_metrics(spark, sf_dir):
    return evaluation.classification_metrics(predicted(spark, sf_dir)).select(*[rounded(m, 8) for m in RATES])


_STEPS = """, c AS (SELECT score, count(*) FILTER (WHERE is_fraud = 1) AS p, count(*) FILTER (WHERE is_fraud = 0) AS n FROM scored GROUP BY 1),
  s AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c)"""


@query(
    "roc_auc",
    """, r AS (SELECT is_fraud, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
       n AS (SELECT count(*) FILTER (WHERE is_fraud = 1) AS p, count(*) FILTER (WHERE is_fraud = 0) AS q, sum(r) FILTER (WHERE is_fraud = 1) AS s FROM r)
       SELECT round(CAST((s - p * (p + 1) / 2) / (p * q) AS DOUBLE), 8) AS roc_auc FROM n""",
    "scored",
)
def roc_auc(spark, sf_dir):
    return evaluation.areas(labelled(spark, sf_dir)).select(rounded("roc_auc", 8))


@query("average_precision", _STEPS + " SELECT round(sum(p / ap * tp / (tp + fp)), 8) AS average_precision FROM s", "scored")
def average_precision(spark, sf_dir):
    return evaluation.areas(labelled(spark, sf_dir)).select(rounded("average_precision", 8))


@query("roc_points", _STEPS + " SELECT round(score, 10) AS threshold, round(fp / an, 8) AS fpr, round(tp / ap, 8) AS tpr FROM s", "scored")
def roc_points(spark, sf_dir):
    found = evaluation.roc_points(labelled(spark, sf_dir))
    return found.select(rounded("threshold", 10), rounded("fpr", 8), rounded("tpr", 8))


@query("pr_points", _STEPS + " SELECT round(score, 10) AS threshold, round(tp / (tp + fp), 8) AS precision, round(tp / ap, 8) AS recall FROM s", "scored")
def pr_points(spark, sf_dir):
    found = evaluation.pr_points(labelled(spark, sf_dir))
    return found.select(rounded("threshold", 10), rounded("precision", 8), rounded("recall", 8))


@query(
    "classification_report",
    f""", c AS (SELECT {_counts()} FROM scored),
        r AS (SELECT '0' AS label, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM c
        UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c),
        t AS (SELECT sum(support) AS n FROM r),
        z AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r
        UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM c, t)
        SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, CAST(support AS BIGINT) AS support FROM z""",
    "scored",
)
def classification_report(spark, sf_dir):
    found = evaluation.classification_report(predicted(spark, sf_dir))
    return found.select("label", *[rounded(m, 8) for m in ("precision", "recall", "f1")], "support")


LIMITS = {"min_accuracy": 0.95, "min_precision": 0.70, "min_recall": 0.45, "min_f1": 0.60, "min_roc_auc": 0.85}


@query(
    "metric_gate",
    f""", c AS (SELECT {_counts()} FROM scored), r AS (SELECT {_RATES} FROM c),
        m AS (SELECT 'accuracy' AS metric, accuracy AS actual, 0.95 AS minimum FROM r UNION ALL SELECT 'precision', precision, 0.70 FROM r
        UNION ALL SELECT 'recall', recall, 0.45 FROM r UNION ALL SELECT 'f1', f1, 0.60 FROM r UNION ALL SELECT 'roc_auc', NULL, 0.85 FROM r)
        SELECT metric, actual, CAST(minimum AS DOUBLE) AS minimum FROM m WHERE actual IS NULL OR actual < minimum""",
    "scored",
)
def metric_gate(spark, sf_dir):
    row = evaluation.classification_metrics(predicted(spark, sf_dir))
    found = evaluation.metric_failures(evaluation.melt_metrics(row, evaluation.METRICS), LIMITS)
    return found.select("metric", rounded("actual", 8), "minimum")


@query(
    "subgroup_metrics",
    f""", c AS (SELECT card4, count(*) AS n, avg(is_fraud) AS rate, {_counts()} FROM scored GROUP BY card4)
        SELECT card4, n, round(rate, 8) AS positive_rate, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision,
        round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM c""",
    "scored",
)
def subgroup_metrics(spark, sf_dir):
    found = evaluation.subgroup_metrics(predicted(spark, sf_dir), "card4")
    return found.select("card4", "n", *[rounded(m, 8) for m in ("positive_rate", "precision", "recall", "f1")])


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query(
    "threshold_sweep",
    f""", g AS (SELECT CAST(unnest([{", ".join(str(t) for t in GRID)}]) AS DOUBLE) AS threshold),
        c AS (SELECT threshold, {_counts("score >= threshold")} FROM scored, g GROUP BY 1) SELECT threshold, {_RATES} FROM c""",
    "scored",
)
def threshold_sweep(spark, sf_dir):
    found = evaluation.threshold_sweep(labelled(spark, sf_dir), GRID)
    return found.select("threshold", *[rounded(m, 8) for m in RATES])


@query(
    "selected_threshold",
    f""", g AS (SELECT CAST(unnest([{", ".join(str(t) for t in GRID)}]) AS DOUBLE) AS threshold),
        c AS (SELECT threshold, {_counts("score >= threshold")} FROM scored, g GROUP BY 1)
        SELECT threshold, f1 FROM (SELECT threshold, {_RATES} FROM c) ORDER BY f1 DESC, threshold LIMIT 1""",
    "scored",
)
def selected_threshold(spark, sf_dir):
    threshold, best = evaluation.select_threshold(labelled(spark, sf_dir), GRID, "f1")
    return spark.createDataFrame([(threshold, round(best, 8))], "threshold double, f1 double")


# -- scoring --------------------------------------------------------------------------------

MODEL_COLUMNS = {"value": "double", "kind": "string", "k": "double", "absent": "double"}


def payloads(events: DataFrame) -> DataFrame:
    """JSON requests out of the event log: plain, nested, with unknown fields, some broken."""
    key = F.col("event_id")
    amount = F.when(key % 9 == 0, F.lit('"unknown"')).otherwise(F.col("value").cast("decimal(12,4)").cast("string"))
    inner = F.concat(
        F.lit('{"kind": "'), "event_type", F.lit('", "value": '), amount, F.lit(', "user": '), F.col("user_id").cast("string"), F.lit("}")
    )
    nested = F.concat(F.lit('{"features": '), inner, F.lit("}"))
    text = F.when(key % 13 == 0, F.lit("{broken")).when(key % 2 == 0, nested).otherwise(inner)
    return events.select("event_id", text.alias("payload"))


_ALIGNED = """SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(CAST(value AS DECIMAL(12, 4)) AS DOUBLE) END AS value,
  event_type AS kind, CAST(NULL AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS absent, 'user' AS ignored, 2 AS missing_feature_count
  FROM events WHERE event_id % 13 <> 0"""


@query("align_features", _ALIGNED)
def align_features(spark, sf_dir):
    parsed = payloads(table(spark, sf_dir, "events")).select("event_id", scoring.parse_payload(F.col("payload")).alias("features"))
    found = scoring.align_features(parsed.where("features IS NOT NULL"), MODEL_COLUMNS)
    return found.select("event_id", *MODEL_COLUMNS, F.concat_ws(",", "ignored_features").alias("ignored"), "missing_feature_count")


@query(
    "score_decision",
    """SELECT txn_id, round(score, 8) AS fraud_probability, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS prediction,
       CASE WHEN score >= 0.4 THEN 'Fraud' ELSE 'Legitimate' END AS label, round(CASE WHEN score >= 0.4 THEN score ELSE 1 - score END, 8) AS confidence,
       CAST(0.4 AS DOUBLE) AS decision_threshold FROM scored""",
    "scored",
)
def score_decision(spark, sf_dir):
    found = scoring.decide(scores(spark, sf_dir), "score", 0.4)
    return found.select(
        "txn_id", F.round("score", 8).alias("fraud_probability"), "prediction", "label", rounded("confidence", 8), "decision_threshold"
    )


_Z95 = 1.959963984540054


@query(
    "probability_interval",
    f"""SELECT txn_id, round(greatest(0, score - {_Z95} * sqrt(score * (1 - score) / 100)), 8) AS lower,
        round(least(1, score + {_Z95} * sqrt(score * (1 - score) / 100)), 8) AS upper FROM scored""",
    "scored",
)
def probability_interval(spark, sf_dir):
    bounds = scoring.interval(F.col("score"), 0.95)
    return scores(spark, sf_dir).select("txn_id", *[F.round(c, 8).alias(n) for n, c in bounds.items()])


# -- serving rollups ---------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a serving log: event type as path, ``k`` as status, value as latency."""
    return prepared(table(spark, sf_dir, "events"))


def prepared(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"),
        F.get_json_object("props", "$.k").alias("status"), "value",
    )


_EVENTS = """WITH e AS (SELECT event_id, ts, event_type AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS status, value,
  CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS w FROM events)"""


def _epoch(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.unix_seconds("window_start"))


@query("event_counts", _EVENTS + " SELECT path, status, count(*) AS n FROM e GROUP BY path, status")
def event_counts(spark, sf_dir):
    return rollups.event_counts(events(spark, sf_dir), ["path", "status"])


_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query(
    "cumulative_histogram",
    _EVENTS + f""", b AS (SELECT CAST(unnest([{", ".join(map(str, _BOUNDS))}, 'inf'::DOUBLE]) AS DOUBLE) AS le)
    SELECT path, le, count(*) FILTER (WHERE value <= le) AS count, round(sum(value), 4) AS value_sum, count(value) AS total FROM e, b GROUP BY path, le""",
)
def cumulative_histogram(spark, sf_dir):
    found = rollups.cumulative_histogram(events(spark, sf_dir), "value", _BOUNDS, ["path"])
    return found.withColumn("value_sum", rounded("value_sum", 4))


@query("windowed_rate", _EVENTS + " SELECT w AS window_start, path, count(*) AS n, round(count(*) / 300, 8) AS per_second FROM e GROUP BY w, path")
def windowed_rate(spark, sf_dir):
    return _epoch(rollups.windowed_rate(events(spark, sf_dir), ["path"])).withColumn("per_second", rounded("per_second", 8))


@query(
    "sliding_rate",
    _EVENTS + """ SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) - o * 60 AS window_start, count(*) AS n, round(count(*) / 300, 8) AS per_second
    FROM e, range(5) r(o) GROUP BY 1""",
)
def sliding_rate(spark, sf_dir):
    return _epoch(rollups.windowed_rate(events(spark, sf_dir), slide="1 minute")).withColumn("per_second", rounded("per_second", 8))


@query(
    "windowed_quantiles",
    _EVENTS + """ SELECT w AS window_start, path, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY w, path""",
)
def windowed_quantiles(spark, sf_dir):
    found = _epoch(rollups.windowed_quantiles(events(spark, sf_dir), "value", by=["path"]))
    return found.withColumns({"p50": rounded("p50"), "p95": rounded("p95")})


@query(
    "bucket_quantiles",
    _EVENTS + f""", b AS (SELECT CAST(unnest([{", ".join(map(str, _BOUNDS))}]) AS DOUBLE) AS le),
    h AS (SELECT path, le, count(*) FILTER (WHERE value <= le) AS c FROM e, b GROUP BY path, le),
    t AS (SELECT path, count(value) * 0.5 AS r FROM e GROUP BY path),
    s AS (SELECT h.path, le, c, lag(le, 1, 0.0) OVER (PARTITION BY h.path ORDER BY le) AS lo, lag(c, 1, 0) OVER (PARTITION BY h.path ORDER BY le) AS below, r
          FROM h JOIN t ON h.path = t.path)
    SELECT path, round(coalesce(min(lo + (le - lo) * (r - below) / (c - below)) FILTER (WHERE c >= r AND below < r), max(le)), 6) AS estimate FROM s GROUP BY path""",
)
def bucket_quantiles(spark, sf_dir):
    histogram = rollups.cumulative_histogram(events(spark, sf_dir), "value", _BOUNDS, ["path"])
    return rollups.bucket_quantile(histogram, 0.5, ["path"]).withColumn("estimate", rounded("estimate"))


@query("windowed_means", _EVENTS + " SELECT w AS window_start, round(avg(value), 6) AS mean_value FROM e GROUP BY w")
def windowed_means(spark, sf_dir):
    return _epoch(rollups.windowed_means(events(spark, sf_dir), ["value"])).withColumn("mean_value", rounded("mean_value"))


@query(
    "evaluation_gauges",
    f""", c AS (SELECT product_cd, {_counts()} FROM scored GROUP BY product_cd),
        r AS (SELECT 'model-' || product_cd AS model, {_RATES} FROM c ORDER BY f1 DESC, product_cd LIMIT 1)
        SELECT model, unnest(['accuracy', 'precision', 'recall', 'f1', 'f2']) AS metric, unnest([accuracy, precision, recall, f1, f2]) AS value FROM r""",
    "scored",
)
def evaluation_gauges(spark, sf_dir):
    found = evaluation.classification_metrics(predicted(spark, sf_dir), ["product_cd"])
    model = F.concat(F.lit("model-"), "product_cd").alias("model")
    table_ = found.select(model, *[rounded(m, 8) for m in RATES], F.lit(None).cast("double").alias("roc_auc"))
    return rollups.evaluation_gauges(table_.orderBy(F.desc("f1"), "model"))


# -- streams --------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.file_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


def event_model(spark: SparkSession, sf_dir: str) -> training.ThresholdModel:
    """One tree fitted on the aligned payloads: which kinds of event are sales."""
    parsed = payloads(table(spark, sf_dir, "events")).select("event_id", scoring.parse_payload(F.col("payload")).alias("features"))
    aligned = scoring.align_features(parsed.where("features IS NOT NULL"), MODEL_COLUMNS)
    known = materialize(aligned.select("event_id", *MODEL_COLUMNS, F.col("kind").isin("purchase", "signup").cast("int").alias("sale")))
    trainer = training.Trainer({"categorical_imputer_strategy": "constant", "numeric_imputer_strategy": "median"}, "sale", "event_id")
    params = {"n_estimators": 1, "max_depth": 6, "bootstrap": False, "max_features": "all"}
    return training.refit(known, trainer, "random_forest", params)[0]


_SALES = f"""WITH a AS ({_ALIGNED}), p AS (SELECT event_id, CASE WHEN kind IN ('purchase', 'signup') THEN 1 ELSE 0 END AS prediction FROM a)
    SELECT event_id, CAST(prediction AS DOUBLE) AS fraud_probability, prediction, CASE WHEN prediction = 1 THEN 'Fraud' ELSE 'Legitimate' END AS label"""


@query("score_model", _SALES + ", CAST(1 AS DOUBLE) AS confidence, CAST(0.5 AS DOUBLE) AS decision_threshold FROM p")
def score_model(spark, sf_dir):
    """A batch of payloads through the fitted model."""
    parsed = payloads(table(spark, sf_dir, "events")).select("event_id", scoring.parse_payload(F.col("payload")).alias("features"))
    found = scoring.score(scoring.align_features(parsed.where("features IS NOT NULL"), MODEL_COLUMNS), event_model(spark, sf_dir))
    return found.select("event_id", rounded("fraud_probability", 8), "prediction", "label", rounded("confidence", 8), "decision_threshold")


@query("stream_scoring", _SALES + " FROM p")
def stream_scoring(spark, sf_dir):
    """The same payloads as a stream through the same fitted model."""
    model = event_model(spark, sf_dir)
    stream = jobs.stream_score(payloads(event_stream(spark, sf_dir)), MODEL_COLUMNS, model)
    found = jobs.run_to_table(stream.select("event_id", "fraud_probability", "prediction", "label"), scratch_path(spark, "stream-scoring"))
    return found.select("event_id", rounded("fraud_probability", 8), "prediction", "label")


@query(
    "stream_rollup",
    _EVENTS + """, last AS (SELECT epoch(max(ts)) AS m FROM e) SELECT w AS window_start, path, count(*) AS n, round(count(*) / 300, 8) AS per_second
    FROM e, last WHERE w + 300 <= m - 600 GROUP BY w, path""",
)
def stream_rollup(spark, sf_dir):
    """Windows closed by the watermark (ten minutes behind the last event)."""
    found = jobs.run_to_table(jobs.stream_counts(prepared(event_stream(spark, sf_dir)), ["path"]), scratch_path(spark, "stream-rollup"))
    return _epoch(found).withColumn("per_second", rounded("per_second", 8))


EVENT_CHECKS = {
    "schema": {
        "null_thresholds": {"value": 0.0, "status": 0.0},
        "categorical_allowed_values": {"path": ["view", "click", "purchase", "signup"]},
    },
    "quality": {"duplicates": {"subset": ["event_id"]}, "outliers": {"columns": ["value"]}, "freshness": {"enabled": False}},
}


@query(
    "stream_quality",
    """SELECT DISTINCT 'unexpected_category' AS "check", 'error' AS severity, 'path' AS "column" FROM events
       WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')
       UNION ALL SELECT 'outlier_fraction', 'warning', 'value' FROM (
         SELECT avg(CASE WHEN abs(0.6745 * (value - m) / d) > 8 THEN 1.0 ELSE 0.0 END) AS f FROM events,
         (SELECT quantile_cont(value, 0.5) AS m FROM events) a, (SELECT quantile_cont(abs(value - (SELECT quantile_cont(value, 0.5) FROM events)), 0.5) AS d FROM events) b)
       WHERE f > 0.05""",
)
def stream_quality(spark, sf_dir):
    found = jobs.stream_quality(prepared(event_stream(spark, sf_dir)), build_suite(EVENT_CHECKS), scratch_path(spark, "stream-quality"))
    return found.select("check", "severity", "column")


