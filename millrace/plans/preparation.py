"""Dataset preparation: join, split, fit preprocessing."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.encoders import build_preprocessing
from ..operators.split import stratified_split
from ..sources.tables import load_joined, path_exists, read_table, save_splits, write_table


def prepare(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """The joined table, written when a path is configured."""
    data = config["data"]
    joined = load_joined(
        spark, data["raw_transaction_path"], data.get("raw_identity_path"), data["id_column"], data.get("sample_size")
    )
    if data.get("processed_path"):
        return read_table(spark, write_table(joined, data["processed_path"]))
    return joined


def split(spark: SparkSession, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Stratified train and test tables, written when paths are configured."""
    data = config["data"]
    stored = data.get("processed_path")
    table = read_table(spark, stored) if stored and path_exists(spark, stored) else prepare(spark, config)
    train, test = stratified_split(table, data["target_column"], data["id_column"], data["test_size"], data["random_state"])
    if data.get("train_path") and data.get("test_path"):
        save_splits(train, test, data["train_path"], data["test_path"])
        return read_table(spark, data["train_path"]), read_table(spark, data["test_path"])
    return train, test


def load_splits(spark: SparkSession, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Stored splits when both are there, else new ones."""
    data = config["data"]
    paths = [data.get("train_path"), data.get("test_path")]
    if all(p and path_exists(spark, p) for p in paths):
        return read_table(spark, paths[0]), read_table(spark, paths[1])
    return split(spark, config)


def featurize(train: DataFrame, config: Mapping[str, Any], path: str | None = None) -> PipelineModel:
    """Preprocessing fitted on the training table only, saved when a path is given."""
    data = config["data"]
    model = build_preprocessing(config["preprocessing"], data["target_column"], [data["id_column"]]).fit(train)
    if path:
        model.write().overwrite().save(path)
    return model
