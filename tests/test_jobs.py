"""Scoring, rollups, streams and whole jobs."""

from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import rollups, scoring
from millrace.operators.quality import build_suite
from millrace.plans import preparation
from millrace.plans.catalog_quality import CONFIG, MONITORING
from millrace.plans.monitoring import run_monitoring
from millrace.plans.validation import run_validation, validate
from millrace.sources import tables
from millrace.streaming import jobs


def test_golden_decision(spark):
    row = scoring.decide(spark.createDataFrame([(0.82,)], "probability double"), threshold=0.4).first()
    assert (row["prediction"], row["label"], row["confidence"], row["decision_threshold"]) == (1, "Fraud", 0.82, 0.4)
    margin = 1.959963984540054 * math.sqrt(0.82 * 0.18 / 100)
    assert (row["lower"], row["upper"]) == (pytest.approx(0.82 - margin), pytest.approx(0.82 + margin))
    low = scoring.decide(spark.createDataFrame([(0.0,), (1.0,)], "probability double")).collect()
    assert [(r["lower"], r["upper"]) for r in low] == [(0.0, 0.0), (1.0, 1.0)] and low[0]["label"] == "Legitimate"
    with pytest.raises(ValueError):
        scoring.interval(F.lit(0.5), 0.4)


def test_alignment(spark):
    df = spark.createDataFrame(
        [('{"features": {"amount": 82.0, "code": "W", "ignored": "value"}}',), ('{"amount": "x"}',), ("{bad",), ("{}",), ("[1]",)], "payload string"
    )
    parsed = df.select("payload", scoring.parse_payload(F.col("payload")).alias("features"))
    assert [r["features"] is None for r in parsed.collect()] == [False, False, True, True, True]
    rows = scoring.align_features(parsed.where("features IS NOT NULL"), {"amount": "double", "code": "string"}).collect()
    assert (rows[0]["amount"], rows[0]["code"], rows[0]["ignored_features"], rows[0]["missing_feature_count"]) == (82.0, "W", ["ignored"], 0)
    assert (rows[1]["amount"], rows[1]["code"], rows[1]["missing_feature_count"]) == (None, None, 1)


def test_bucket_quantile(spark):
    df = spark.createDataFrame([("a", 0.3), ("a", 0.7), ("a", 1.5), ("a", 3.5), ("b", 99.0)], "p string, x double")
    histogram = rollups.cumulative_histogram(df, "x", [1.0, 2.0, 4.0], ["p"])
    counts = {(r["p"], r["le"]): r["count"] for r in histogram.collect()}
    assert counts[("a", 1.0)] == 2 and counts[("b", 4.0)] == 0 and counts[("b", float("inf"))] == 1
    found = {r["p"]: r["estimate"] for r in rollups.bucket_quantile(histogram, 0.625, ["p"]).collect()}
    assert found == {"a": pytest.approx(1.5), "b": 4.0}


def test_approximate_quantiles(spark):
    df = spark.range(1000).select(F.timestamp_seconds(F.col("id") % 600).alias("ts"), F.col("id").alias("x"))
    exact = rollups.windowed_quantiles(df, "x").orderBy("window_start").collect()
    near = rollups.windowed_quantiles(df, "x", approximate=True).orderBy("window_start").collect()
    assert len(exact) == 2 and all(abs(a["p95"] - b["p95"]) < 20 for a, b in zip(exact, near))


@pytest.fixture()
def event_files(spark, tmp_path):
    """Four files: the second moves the watermark, which the fourth's late row then misses."""
    def write(name, seconds):
        df = spark.createDataFrame([(s, "a", 1.0) for s in seconds], "s bigint, path string, value double")
        time.sleep(0.05)  # files are read in the order of their times
        df.select(F.timestamp_seconds("s").alias("ts"), "path", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write("1", [10, 20, 310])
    write("2", [4000])
    write("3", [4050])
    write("4", [30, 4100, 9000])
    return str(tmp_path / "in"), str(tmp_path)


def test_stream_rollup_equals_batch_but_for_late_rows(spark, event_files):
    folder, work = event_files
    schema = spark.read.parquet(folder).schema
    stream = jobs.file_stream(spark, folder, "*.parquet", schema, files_per_batch=1)
    found = jobs.run_to_table(jobs.stream_counts(stream, ["path"]), f"{work}/out")
    seen = {r["s"]: r["n"] for r in found.select(F.unix_seconds("window_start").alias("s"), "n").collect()}
    assert seen == {0: 2, 300: 1, 3900: 3}
    again = jobs.run_to_table(jobs.stream_counts(jobs.file_stream(spark, folder, "*.parquet", schema, 1), ["path"]), f"{work}/out")
    assert again.count() == 3  # a restart repeats nothing


def test_stream_means(spark, event_files):
    folder, work = event_files
    stream = jobs.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
    assert {r["mean_value"] for r in jobs.run_to_table(jobs.stream_means(stream, ["value"]), f"{work}/m").collect()} == {1.0}


def test_stream_quality_per_batch(spark, event_files):
    folder, work = event_files
    suite = build_suite({"schema": {"categorical_allowed_values": {"path": ["b"]}}, "quality": {"freshness": {"enabled": False}}})
    stream = jobs.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema, files_per_batch=1)
    found = jobs.stream_quality(stream, suite, f"{work}/q").where("check = 'unexpected_category'")
    assert sorted(r["batch"] for r in found.collect()) == [0, 1, 2, 3]


def test_validation_run_fails_and_reports(spark, txn, tmp_path):
    data = tables.write_table(txn, str(tmp_path / "t.parquet"))
    result = run_validation(spark, CONFIG, data, report_path=str(tmp_path / "report"), baseline_path=str(tmp_path / "profile"))
    assert not result.passed and result.exit_code == 1 and result.row_count == txn.count()
    assert {"schema_contract", "missing_value_threshold", "unexpected_category"} <= {i.check for i in result.errors}
    assert spark.read.json(str(tmp_path / "report/issues")).count() == len(result.issues)
    assert tables.load_profile(spark, str(tmp_path / "profile")) is not None
    assert result.metrics["drift"]["distribution_drift"]["mode"] == "baseline_statistics"


def test_clean_table_passes(spark):
    df = spark.range(50).selectExpr("id", "CAST(id % 2 AS INT) AS y", "CAST(id AS STRING) AS x")
    config = {
        "validation": {"id_column": "id"},
        "schema": {"required_columns": [{"name": "x", "dtype": "float"}], "numeric_ranges": {"x": {"min": 0, "max": 49}}},
        "quality": {"duplicates": {"subset": ["id"]}, "class_imbalance": {"target_column": "y"}, "freshness": {"enabled": False}},
        "drift": {"numeric_columns": ["x"], "categorical_columns": ["y"]},
    }
    result = validate(df, config, df)
    assert result.passed and result.issues == []
    assert validate(df, config).warnings and validate(df, config).passed
    assert not validate(df, config, fail_on_warnings=True).passed


def test_monitoring_run(spark, txn):
    found = run_monitoring(txn, "txn_id", "is_fraud", MONITORING, ["txn_amt", "txn_dt", "card1"], ["product_cd", "card4", "card6", "p_email"])
    rows = {r["report"]: r for r in found.summary.collect()}
    assert rows["baseline"]["number_of_columns"] == 8 and rows["drift"]["number_of_drifted_columns"] >= 5
    events = {r["report"]: r["event"] for r in found.status.collect()}
    assert events["drift"] == "data_drift_detected"
    assert {r["slice"] for r in found.quality.collect()} == {"reference", "clean_current", "drifted_current"}
    assert found.performance is None


def test_monitoring_query_takes_all_rows(spark, txn, monkeypatch):
    """Both halves together hold every row, however long the table (10,000 rows were the most before)."""
    from millrace.plans import catalog_quality

    found = []
    run = catalog_quality.run_monitoring
    monkeypatch.setattr(catalog_quality, "run_monitoring", lambda *a, **how: found.append(run(*a, **how)) or found[-1])
    monkeypatch.setattr(catalog_quality, "transactions", lambda spark, sf_dir: long)
    long = txn.crossJoin(spark.range(-(-10_500 // txn.count())).withColumnRenamed("id", "_n")).withColumn("txn_id", F.col("txn_id") * 1000 + F.col("_n")).drop("_n")
    catalog_quality.monitoring_run(spark, None)
    sizes = {r["slice"]: r["count"] for r in found[0].quality.where("column = 'txn_dt'").collect()}
    assert sizes["reference"] + sizes["clean_current"] == long.where("txn_dt IS NOT NULL").count() > 10_000


def test_monitoring_by_a_callers_rule(spark, txn):
    half, rows = F.col("txn_id") % 3 == 0, txn.where("txn_dt IS NOT NULL")
    found = run_monitoring(rows, "txn_id", "is_fraud", MONITORING, ["txn_dt"], ["product_cd"], in_reference=half, drifted_rows=F.col("txn_id") % 2 == 0)
    sizes = {r["slice"]: r["count"] for r in found.quality.collect()}
    assert sizes == {"reference": rows.where(half).count(), "clean_current": rows.where(~half).count(), "drifted_current": rows.where(~half).count()}
    moved = found.categories.where("slice = 'drifted_current' AND column = 'product_cd' AND value = '1'").first()
    assert moved["share"] > 0.4


def test_monitoring_with_a_model(spark, txn):
    from pyspark.ml.feature import SQLTransformer

    model = SQLTransformer(statement="SELECT *, CASE WHEN coalesce(txn_amt, 0) > 400000 THEN 1.0 ELSE 0.0 END AS prediction FROM __THIS__")
    found = run_monitoring(txn, "txn_id", "is_fraud", {**MONITORING, "sample_size": 300}, ["txn_amt"], ["product_cd"], model)
    assert {r["slice"] for r in found.performance.collect()} == {"reference", "clean_current", "drifted_current"}


def test_preparation(spark, txn, tmp_path):
    side = txn.where("txn_id % 2 = 0").select("txn_id", F.lit("phone").alias("device"))
    tables.write_table(txn, str(tmp_path / "f.parquet"))
    tables.write_table(side, str(tmp_path / "i.parquet"))
    config = {
        "data": {
            "raw_transaction_path": str(tmp_path / "f.parquet"), "raw_identity_path": str(tmp_path / "i.parquet"), "id_column": "txn_id",
            "target_column": "is_fraud", "test_size": 0.2, "random_state": 42, "sample_size": None,
            "processed_path": str(tmp_path / "p.parquet"), "train_path": str(tmp_path / "train.parquet"), "test_path": str(tmp_path / "test.parquet"),
        },
        "preprocessing": {"numeric_imputer_strategy": "median", "scaler": "none"},
    }
    train, test = preparation.load_splits(spark, config)
    assert train.count() + test.count() == txn.count() and "device" in train.columns
    assert preparation.load_splits(spark, config)[1].count() == test.count()
    model = preparation.featurize(train, config, str(tmp_path / "model"))
    assert tables.path_exists(spark, str(tmp_path / "model")) and model.transform(test).count() == test.count()


def test_scratch_needs_a_shared_folder(spark, tmp_path):
    from millrace.session import scratch_path, shared_dir

    assert shared_dir(spark) and scratch_path(spark, "x").startswith(shared_dir(spark))


def test_stream_scores_with_a_fitted_model(spark, txn, tmp_path):
    """Encodings, imputation, one-hot and a forest on a stream; a second run takes up only what is new, and no row comes twice."""
    from millrace.operators import scoring, training
    from millrace.plans.catalog_training import KEY, SETTINGS, TARGET
    from millrace.streaming import jobs

    settings = {**SETTINGS, "use_polynomial_features": False, "use_feature_selection": False, "use_variance_threshold": False}
    columns = {"txn_amt": "double", "card1": "double", "product_cd": "string", "card4": "string", "p_email": "string", "addr1": "double", "r_email": "string"}
    known = txn.select(KEY, TARGET, *columns)
    saved = str(tmp_path / "model")
    training.refit(known, training.Trainer(settings, TARGET, KEY), "random_forest", {"n_estimators": 3, "max_depth": 4})[0].write().save(saved)
    model = training.ThresholdModel.load(saved)
    payload = F.to_json(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]))
    rows = txn.select(KEY, payload.alias("payload"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.where(f"{KEY} % 2 = 0").coalesce(1).write.parquet(source)

    def run():
        stream = jobs.stream_score(jobs.file_stream(spark, source, "*.parquet", rows.schema), columns, model)
        return jobs.run_to_table(stream.select(KEY, "fraud_probability", "prediction"), out)

    first = run().count()
    rows.where(f"{KEY} % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    found = {r[KEY]: tuple(r)[1:] for r in run().collect()}
    parsed = rows.select(KEY, scoring.parse_payload(F.col("payload")).alias("features"))
    batch = scoring.score(scoring.align_features(parsed, columns), model).select(KEY, "fraud_probability", "prediction").collect()
    assert 0 < first < len(batch) and run().count() == len(batch)
    assert found == {r[KEY]: tuple(r)[1:] for r in batch} and len({p for p, _ in found.values()}) > 3


def test_validation_settings_are_required(spark, tmp_path):
    from millrace.config import SAMPLE_VALIDATION, ConfigError

    for name in ("dataset_name", "input_data_path", "target_column"):
        for bad in (None, " "):
            settings = {**SAMPLE_VALIDATION, "validation": {**SAMPLE_VALIDATION["validation"], name: bad}}
            with pytest.raises(ConfigError, match=name):
                run_validation(spark, settings)
    with pytest.raises(ConfigError, match="dataset_name, input_data_path, target_column"):
        run_validation(spark, {})
    with pytest.raises(tables.TableNotFound):  # the path may be an argument
        run_validation(spark, {**SAMPLE_VALIDATION, "validation": {**SAMPLE_VALIDATION["validation"], "input_data_path": None}}, str(tmp_path / "none.csv"))
