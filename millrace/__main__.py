"""Command line: ``python -m millrace <job> --config settings.yaml`` (under spark-submit as well)."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import load_config
from .operators.training import ThresholdModel
from .plans import preparation
from .plans.monitoring import run_monitoring
from .plans.training_job import gate_model, train
from .plans.validation import run_validation
from .session import get_session
from .sources.tables import path_exists, read_table, write_table

JOBS = ("validate", "prepare", "split", "featurize", "train", "evaluate", "monitor")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("job", choices=JOBS)
    p.add_argument("--config", required=True, help="settings of the job (YAML)")
    p.add_argument("--validation-config", help="contract, drift columns and metric limits (evaluate, monitor)")
    p.add_argument("--input", help="table to work on, instead of the configured one")
    p.add_argument("--reference", help="reference table (validate)")
    p.add_argument("--output", help="folder for reports, the model or results")
    p.add_argument("--update-baseline", action="store_true")
    p.add_argument("--fail-on-warnings", action="store_true", default=None)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = load_config(args.config)
    spark = spark or get_session()
    if args.job == "validate":
        result = run_validation(
            spark, config, args.input, args.reference, args.output, update_baseline=args.update_baseline,
            fail_on_warnings=args.fail_on_warnings,
        )
        for issue in result.issues:
            print(f"{issue.severity.upper()} {issue.check}: {issue.message}")
        return result.exit_code
    if args.job == "prepare":
        preparation.prepare(spark, config)
        return 0
    if args.job == "split":
        preparation.split(spark, config)
        return 0
    data, artifacts = config["data"], config.get("artifacts", {})
    model_path = artifacts.get("best_model_path")
    if args.job == "featurize":
        preparation.featurize(
            preparation.load_splits(spark, config)[0], config, args.output or artifacts.get("preprocessing_pipeline_path")
        )
        return 0
    if args.job == "train":
        table, _ = train(*preparation.load_splits(spark, config), config, args.output or model_path, artifacts.get("results_path"))
        table.show(truncate=False)
        return 0
    limits = load_config(args.validation_config) if args.validation_config else config
    if args.job == "evaluate":
        test = args.input or data["test_path"]
        rows = read_table(spark, test) if path_exists(spark, test) else None
        metrics, failures = gate_model(
            spark, limits.get("model_validation", {}), data["target_column"], rows, model_path, artifacts.get("results_path")
        )
        metrics.show(truncate=False)
        failures.show(truncate=False)
        return 0 if failures.isEmpty() else 1
    settings, drift = config.get("monitoring", {}), limits.get("drift", {})
    model = ThresholdModel.load(model_path) if model_path and path_exists(spark, model_path) else None
    found = run_monitoring(
        read_table(spark, args.input or settings.get("source_data_path") or data["test_path"]), data["id_column"], data["target_column"],
        settings, drift.get("numeric_columns", []), drift.get("categorical_columns", []), model,
    )
    found.status.show(truncate=False)
    if args.output:
        write_table(found.summary, f"{args.output}/summary.json")
        write_table(found.quality, f"{args.output}/quality.parquet")
    return 0


if __name__ == "__main__":
    sys.exit(main())
