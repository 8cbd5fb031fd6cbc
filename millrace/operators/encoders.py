"""Fitted preprocessing steps as Spark ML Estimators and Models.

Fitted state is either a handful of numbers per column (kept as parameters) or
a lookup table with one row per category (a DataFrame, saved as parquet).
Encodings that share a key share one table and one join.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import CountVectorizerModel, PolynomialExpansion, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import (
    amount_features,
    category,
    combined_category,
    email_match,
    email_parts,
    group_ratio,
    missing_features,
    seeded_hash,
    time_features,
    to_number,
    value_text,
)
from ..session import materialize, materialize_counted
from .joins import category_shares, within_budget
from .ordered import exact_quantiles, group_quantiles
from .profile import chunks, column_types


class _Settings(Params):
    """Settings and fitted numbers as JSON text parameters."""

    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)
    fitted = Param(Params._dummy(), "fitted", "fitted numbers as JSON", TypeConverters.toString)

    def get_settings(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.settings))

    def get_fitted(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.fitted))

    def _with(self, settings: Mapping[str, Any] | None = None, fitted: Mapping[str, Any] | None = None):
        if settings is not None:
            self._set(settings=json.dumps(dict(settings)))
        if fitted is not None:
            self._set(fitted=json.dumps(dict(fitted)))
        return self


def sized_vector(vector: Column, size: int, name: str) -> Column:
    """A vector column that says how long it is, so that an assembler need not look at a row (which a stream does not allow)."""
    return vector.alias(name, metadata={"ml_attr": {"num_attrs": size}})


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for name, table in self.instance.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        names = model.get_fitted()["tables"]
        model.tables = {n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in names}
        return model


class _TableModel(Model, _Settings, MLReadable, MLWritable):
    """A model whose fitted state includes lookup tables."""

    def __init__(self):
        super().__init__()
        self.tables: dict[str, DataFrame] = {}

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def copy(self, extra=None):
        twin = super().copy(extra)
        twin.tables = dict(self.tables)
        return twin


# -- feature engineering --------------------------------------------------------------


def _key_column(df: DataFrame, columns: Sequence[str]) -> Column:
    return category(df, columns[0]) if len(columns) == 1 else combined_category(df, columns)


def encoding_keys(df: DataFrame, settings: Mapping[str, Any], supervised: bool) -> dict[str, dict[str, Any]]:
    """Which encodings each key (a column or a combination) has to carry."""
    keys: dict[str, dict[str, Any]] = {}

    def want(columns: Sequence[str], use: str) -> None:
        if all(c in df.columns for c in columns):
            keys.setdefault("_x_".join(columns), {"columns": list(columns), "uses": []})["uses"].append(use)

    if settings.get("use_frequency_encoding", False):
        for c in settings.get("frequency_encode_features", []):
            want([c], "frequency")
    if settings.get("use_target_mean_encoding", False) and supervised:
        for c in settings.get("target_mean_encode_features", []):
            want([c], "target_mean")
        for pair in settings.get("target_mean_encode_interactions", []):
            if len(pair) >= 2:
                want(pair, "target_mean")
    if settings.get("use_amount_group_features", False) and settings.get("amount_column", "TransactionAmt") in df.columns:
        for c in settings.get("amount_groupby_features", []):
            want([c], "median")
    return keys


def _keyed_rows(df: DataFrame, keys: Mapping[str, Mapping[str, Any]], extra: Mapping[str, Column]) -> DataFrame:
    """One row per source row and key: all encodings are then one aggregation."""
    values = F.array(*[F.struct(F.lit(k).alias("key"), _key_column(df, s["columns"]).alias("value")) for k, s in keys.items()])
    base = df.select(*[c.alias(n) for n, c in extra.items()], F.explode(values).alias("_kv"))
    return base.select("_kv.key", "_kv.value", *extra)


def fold_of(df: DataFrame, settings: Mapping[str, Any], passthrough: Sequence[str], target: str | None) -> Column | None:
    """The fold (from 0) a row's target is left out with, by a hash of its key: the first carried column, or all features where none is carried.
    NULL where target means are fitted in-sample (``target_mean_folds`` below 2, the default)."""
    folds = int(settings.get("target_mean_folds") or 0)
    if folds < 2:
        return None
    carried = [c for c in passthrough if c in df.columns]
    return F.pmod(seeded_hash(int(settings.get("target_mean_seed", 42)), *(carried[:1] or [F.col(f"`{c}`") for c in df.columns if c != target])), F.lit(folds)).cast("int")


def fit_encodings(
    df: DataFrame, settings: Mapping[str, Any], target: str | None, passthrough: Sequence[str] = ()
) -> tuple[DataFrame | None, dict[str, Any]]:
    """(``key, value, frequency, target_mean, median, left_out`` table, fitted numbers). ``left_out`` has a target mean per fold, of
    the rows of the other folds alone; NULL without folds."""
    supervised = bool(target and target in df.columns)
    keys = encoding_keys(df, settings, supervised)
    fitted: dict[str, Any] = {"keys": keys, "size": {}, "target_mean": 0.0, "left_out": [], "median": 0.0, "tables": []}
    amount = settings.get("amount_column", "TransactionAmt")
    if not keys:
        return None, fitted
    y = to_number(df, target) if supervised else F.lit(None).cast("double")
    fold = fold_of(df, settings, passthrough, target) if supervised else None
    folds = int(settings["target_mean_folds"]) if fold is not None else 1
    of = (fold if fold is not None else F.lit(0)).alias("fold")
    parts = {r["fold"]: r for r in df.select(y.alias("y"), of).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count("y").alias("n"), F.sum("y").alias("s")).collect()}
    rows, n, total = (sum(r[c] or 0 for r in parts.values()) for c in ("rows", "n", "s"))
    mean = total / n if n else None
    if mean is None:
        keys = {k: {**s, "uses": [u for u in s["uses"] if u != "target_mean"]} for k, s in keys.items()}
        keys = {k: s for k, s in keys.items() if s["uses"]}
    fitted.update(keys=keys, target_mean=mean or 0.0)
    if not keys:
        return None, fitted
    smoothing = float(settings.get("target_mean_smoothing", 20.0))
    counted = _keyed_rows(df, keys, {"y": y, "fold": of}).groupBy("key", "value", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("n_y"), F.sum("y").alias("sum_y")
    )
    per_fold = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n_y", F.coalesce("sum_y", F.lit(0.0)).alias("sum_y")))))
    whole = counted.groupBy("key", "value").agg(F.sum("n").alias("n"), F.sum("n_y").alias("n_y"), F.sum("sum_y").alias("sum_y"), per_fold.alias("folds"))
    left_out = F.lit(None).cast("array<double>")
    if fold is not None and mean is not None:
        others = [(n - r["n"], total - (r["s"] or 0.0)) if (r := parts.get(f)) else (n, total) for f in range(folds)]
        fitted["left_out"] = [t / k if k else mean for k, t in others]
        left_out = F.array(*[_left_out_mean(F.try_element_at("folds", F.lit(f)), prior, smoothing) for f, prior in enumerate(fitted["left_out"])])
    table = whole.select(
        "key",
        "value",
        (F.col("n").cast("double") / F.lit(rows)).alias("frequency"),
        F.when(F.col("n_y") > 0, (F.col("sum_y") + F.lit(smoothing * (mean or 0.0))) / (F.col("n_y") + F.lit(smoothing)))
        .alias("target_mean"),
        left_out.alias("left_out"),
    )
    medians = {k: s for k, s in keys.items() if "median" in s["uses"]}
    if medians:
        amounts = df.select("*", to_number(df, amount).alias("_amount"))
        fitted["median"] = exact_quantiles(amounts.select("_amount"), ["_amount"], [0.5])["_amount"][0] or 0.0
        found = group_quantiles(_keyed_rows(amounts, medians, {"_amount": F.col("_amount")}), ["key", "value"], "_amount", [0.5])
        found = found.select("key", "value", F.col("quantiles")[0].alias("median"))
        table = table.join(found, ["key", "value"], "left")
    else:
        table = table.withColumn("median", F.lit(None).cast("double"))
    table = materialize(table)
    # A fold's mean weighs as much as a character or two of text in a broadcast.
    sizes = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 8 * len(fitted["left_out"])).alias("b"))
    fitted["size"] = {r["key"]: [r["n"], r["b"]] for r in sizes.collect()}
    fitted["tables"] = ["encodings"]
    return table, fitted


def _left_out_mean(own: Column, prior: float, smoothing: float) -> Column:
    """The smoothed mean of a value's rows outside one fold, given the fold's own count and sum."""
    n = F.col("n_y") - F.coalesce(own["n_y"], F.lit(0))
    total = F.coalesce("sum_y", F.lit(0.0)) - F.coalesce(own["sum_y"], F.lit(0.0))
    return F.when(n > 0, (total + F.lit(smoothing * prior)) / (n + F.lit(smoothing))).otherwise(F.lit(prior))


class FeatureEngineer(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Row features and fitted encodings, in a fixed order of columns."""

    def __init__(self, settings: Mapping[str, Any] | None = None, target: str | None = None, passthrough: Sequence[str] = ()):
        super().__init__()
        self._with({"config": dict(settings or {}), "target": target, "passthrough": list(passthrough)}, {})

    def _fit(self, df: DataFrame) -> FeatureEngineerModel:
        own = self.get_settings()
        config = own["config"]
        table, fitted = None, {"keys": {}, "size": {}, "target_mean": 0.0, "left_out": [], "median": 0.0, "tables": []}
        if config.get("use_feature_engineering", False):
            table, fitted = fit_encodings(df, config, own["target"], own["passthrough"])
        model = FeatureEngineerModel()._with(own, fitted)
        model.tables = {"encodings": table} if table is not None else {}
        model._seen = df if fitted["left_out"] else None
        return model


class FeatureEngineerModel(_TableModel):
    """With ``target_mean_folds``, rows that are learned from get the target means of the other folds (``for_training``): also
    the very frame the model was fitted on, when a pipeline passes it on to the stages behind. Other rows get those of all rows."""

    _seen: DataFrame | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        if df is self._seen:
            self._seen = None
            return self.for_training(df)
        return self._engineered(df, None)

    def for_training(self, df: DataFrame) -> DataFrame:
        own = self.get_settings()
        return self._engineered(df, fold_of(df, own["config"], own["passthrough"], own["target"]))

    def _engineered(self, df: DataFrame, fold: Column | None) -> DataFrame:
        own = self.get_settings()
        return engineer(df, own["config"], self.get_fitted(), self.tables.get("encodings"), own["target"], own["passthrough"], fold)


def engineer(
    df: DataFrame,
    config: Mapping[str, Any],
    fitted: Mapping[str, Any],
    encodings: DataFrame | None,
    target: str | None = None,
    passthrough: Sequence[str] = (),
    fold: Column | None = None,
) -> DataFrame:
    """Apply row features and encodings; ``passthrough`` and target are carried along. Given a row's ``fold``, its target means are those of
    the other folds."""
    if not config.get("use_feature_engineering", False):
        return df
    carried = [c for c in df.columns if c == target or c in set(passthrough)]
    features = [c for c in df.columns if c not in carried]
    row: dict[str, Column] = {}
    if config.get("use_missing_pattern_features", False):
        row.update(missing_features(df, config.get("missing_indicator_prefixes", []), features))
    for c in config.get("log_transform_features", []):
        if c in features:
            row.update(amount_features(df, c))
    time = config.get("transaction_time_column", "TransactionDT")
    if config.get("use_transaction_time_features", False) and time in features:
        row.update(time_features(df, time))
    late: dict[str, Column] = {}
    for c in config.get("email_domain_features", []):
        if c in features:
            late.update(email_parts(df, c))
    pair = config.get("email_match_features", ["P_emaildomain", "R_emaildomain"])
    if len(pair) == 2 and set(pair) <= set(features):
        late["email_domain_match"] = email_match(df, *pair)
    for combo in config.get("interaction_features", []):
        if len(combo) == 2 and set(combo) <= set(features):
            late["_x_".join(combo)] = combined_category(df, combo)
    text = {c for c in config.get("categorical_like_numeric_features", []) if c in features}
    keys = {k: s for k, s in fitted["keys"].items() if set(s["columns"]) <= set(features)} if encodings is not None else {}
    amount = config.get("amount_column", "TransactionAmt")
    amounts = to_number(df, amount) if amount in features else F.lit(None).cast("double")

    wide = df.select(
        *carried,
        *[(value_text(df, c) if c in text else F.col(c)).alias(c) for c in features],
        *[c.alias(n) for n, c in {**row, **late}.items()],
        amounts.alias("_amount"),
        (fold if fold is not None else F.lit(None)).cast("int").alias("_fold"),
        *[_key_column(df, s["columns"]).alias(f"_key{i}") for i, s in enumerate(keys.values())],
    )
    encoded: dict[str, Column] = {}
    grouped: dict[str, Column] = {}
    small = within_budget({k: fitted["size"].get(k, [0, 0]) for k in keys})
    fallback = fitted["median"] if fitted["median"] > 0 else 1.0
    for i, (key, spec) in enumerate(keys.items()):
        table = encodings.where(F.col("key") == key).select(
            F.col("value").alias(f"_key{i}"),
            F.col("frequency").alias(f"_f{i}"), F.col("target_mean" if fold is None else "left_out").alias(f"_t{i}"), F.col("median").alias(f"_m{i}"),
        )
        wide = wide.join(F.broadcast(table) if key in small else table, f"_key{i}", "left")
        if "frequency" in spec["uses"]:
            encoded[f"{key}_frequency"] = F.coalesce(F.col(f"_f{i}"), F.lit(0.0))
        if "target_mean" in spec["uses"]:
            mean, prior = F.col(f"_t{i}"), F.lit(float(fitted["target_mean"]))
            if fold is not None:
                mean, prior = mean[F.col("_fold")], F.array(*[F.lit(float(p)) for p in fitted["left_out"]])[F.col("_fold")]
            encoded[f"{key}_target_mean"] = F.coalesce(mean, prior)
        if "median" in spec["uses"]:
            median = F.coalesce(F.col(f"_m{i}"), F.lit(float(fallback)))
            grouped[f"{amount}_to_{key}_median"] = group_ratio(F.col("_amount"), median)
            grouped[f"{amount}_minus_{key}_median"] = F.col("_amount") - median
    frequency = {n: c for n, c in encoded.items() if n.endswith("_frequency")}
    means = {n: c for n, c in encoded.items() if n not in frequency}
    return wide.select(
        *carried, *features, *row,
        *[c.alias(n) for n, c in {**frequency, **means, **grouped}.items()],
        *late,
    )


# -- numeric columns ------------------------------------------------------------------


def fit_numeric(df: DataFrame, columns: Sequence[str], settings: Mapping[str, Any]) -> dict[str, Any]:
    """Fill values, indicator columns, and centre and scale of each output column.

    Scaling is fitted on the filled values and covers the indicators, which
    come before the scaler.
    """
    strategy, scaler = settings.get("strategy", "median"), settings.get("scaler")
    if scaler not in (None, "none", "robust", "standard"):
        raise ValueError(f"unsupported scaler: {scaler}")
    data = df.select(*[to_number(df, c).alias(c) for c in columns]).persist()
    try:
        return _fit_numeric(data, columns, settings, strategy, scaler)
    finally:
        data.unpersist()


def _fit_numeric(
    data: DataFrame, columns: Sequence[str], settings: Mapping[str, Any], strategy: str, scaler: str | None
) -> dict[str, Any]:
    counts: dict[str, Any] = {}
    for part in chunks(list(columns)):
        row = data.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(c).alias(f"n{i}") for i, c in enumerate(part)],
            *[F.avg(c).alias(f"a{i}") for i, c in enumerate(part)],
        ).first()
        counts.update({c: (row["rows"], row[f"n{i}"], row[f"a{i}"]) for i, c in enumerate(part)})
    known = [c for c in columns if counts[c][1]]  # columns without any value are dropped
    given = {c: counts[c][1] for c in known}
    if strategy == "median":
        fill = {c: q[0] for part in chunks(known) for c, q in exact_quantiles(data, part, [0.5], sizes=given).items()}
    elif strategy == "mean":
        fill = {c: counts[c][2] for c in known}
    elif strategy == "constant":
        fill = {c: float(settings.get("fill_value", 0.0)) for c in known}
    elif strategy == "most_frequent":
        fill = {}
        for c in known:
            top = data.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            fill[c] = top.orderBy(F.desc("n"), c).limit(1).first()[c]
    else:
        raise ValueError(f"unsupported imputation: {strategy}")
    flags = [c for c in known if counts[c][1] < counts[c][0]] if settings.get("add_indicator", False) else []
    fitted: dict[str, Any] = {"fill": fill, "flags": flags, "center": {}, "scale": {}}
    filled = data.select(
        *[F.coalesce(F.col(c), F.lit(float(fill[c]))).alias(c) for c in known],
        *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in flags],
    )
    names = filled.columns
    all_rows = {c: counts[known[0]][0] for c in names} if known else {}
    if scaler == "robust":
        for part in chunks(names):
            for c, (low, middle, high) in exact_quantiles(filled, part, [0.25, 0.5, 0.75], sizes=all_rows).items():
                fitted["center"][c], fitted["scale"][c] = middle, (high - low) or 1.0
    elif scaler == "standard":
        for part in chunks(names):
            row = filled.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(part) for k, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
            for i, c in enumerate(part):
                fitted["center"][c], fitted["scale"][c] = row[f"a{i}"], row[f"s{i}"] or 1.0
    return fitted


def numeric_outputs(df: DataFrame, fitted: Mapping[str, Any]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c, value in fitted["fill"].items():
        present = to_number(df, c) if c in df.columns else F.lit(None).cast("double")
        out[c] = F.coalesce(present, F.lit(float(value)))
    for c in fitted["flags"]:
        missing = to_number(df, c).isNull() if c in df.columns else F.lit(True)
        out[f"{c}_missing"] = missing.cast("double")
    return {
        n: (c - F.lit(float(fitted["center"][n]))) / F.lit(float(fitted["scale"][n])) if n in fitted["scale"] else c
        for n, c in out.items()
    }


class NumericPrep(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Impute, add missing indicators and scale the numeric features into one vector."""

    def __init__(self, settings: Mapping[str, Any] | None = None, columns: Sequence[str] | None = None,
                 excluded: Sequence[str] = (), output: str = "numeric_vector"):
        super().__init__()
        self._with({"config": dict(settings or {}), "columns": list(columns) if columns is not None else None,
                    "excluded": list(excluded), "output": output}, {})

    def _fit(self, df: DataFrame) -> NumericPrepModel:
        own = self.get_settings()
        columns = own["columns"]
        if columns is None:
            columns = column_types(df.drop(*own["excluded"]))[0]
        return NumericPrepModel()._with(own, fit_numeric(df, columns, own["config"]))


class NumericPrepModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        own, values = self.get_settings(), numeric_outputs(df, self.get_fitted())
        vector = array_to_vector(F.array(*values.values())) if values else array_to_vector(F.array().cast("array<double>"))
        return df.select("*", sized_vector(vector, len(values), own["output"]))

    def output_names(self) -> list[str]:
        fitted = self.get_fitted()
        return [*fitted["fill"], *[f"{c}_missing" for c in fitted["flags"]]]


# -- categorical columns ----------------------------------------------------------------


def category_slots(
    df: DataFrame, columns: Sequence[str], fill: str = "missing", min_frequency: int | None = None,
    max_categories: int | None = None,
) -> DataFrame:
    """``column, value, n, slot``: the one-hot slot of every value seen.

    Frequent values come first in order of value. Rare values, and values
    beyond the limit by count, share the last slot of the column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(value_text(df, c), F.lit(fill)).alias("value")) for c in columns])
    tidy = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
    counts, _ = materialize_counted(tidy.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    kept = counts if not min_frequency else counts.where(F.col("n") >= min_frequency)
    if max_categories:
        # The shared slot counts towards the limit, where there is one.
        total = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_all"))
        frequent = kept.groupBy("column").agg(F.count(F.lit(1)).alias("_kept"))
        room = total.join(F.broadcast(frequent), "column", "left").select(
            "column",
            F.when((F.col("_all") == F.col("_kept")) & (F.col("_kept") <= max_categories), F.lit(max_categories))
            .otherwise(F.lit(max_categories - 1)).alias("_room"),
        )
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
        kept = kept.withColumn("_rank", rank).where(F.col("_rank") <= max_categories)
        kept = kept.join(F.broadcast(room), "column").where(F.col("_rank") <= F.col("_room")).select("column", "value", "n")
    order = Window.partitionBy("column").orderBy("value")
    frequent_slots = kept.select("column", "value", (F.row_number().over(order) - 1).alias("slot"))
    sizes = frequent_slots.groupBy("column").agg(F.count(F.lit(1)).cast("int").alias("_k"))
    slots = counts.join(frequent_slots, ["column", "value"], "left").join(F.broadcast(sizes), "column", "left")
    return slots.select(
        "column", "value", "n",
        F.col("slot").isNull().alias("is_infrequent"),
        F.coalesce("slot", "_k", F.lit(0)).alias("slot"),
    )


class CategoryEncoder(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Impute a constant and one-hot encode into one sparse vector; unknown values are all zero."""

    def __init__(self, settings: Mapping[str, Any] | None = None, columns: Sequence[str] | None = None,
                 excluded: Sequence[str] = (), output: str = "category_vector"):
        super().__init__()
        self._with({"config": dict(settings or {}), "columns": list(columns) if columns is not None else None,
                    "excluded": list(excluded), "output": output}, {})

    def _fit(self, df: DataFrame) -> CategoryEncoderModel:
        own = self.get_settings()
        config, columns = own["config"], own["columns"]
        if columns is None:
            columns = column_types(df.drop(*own["excluded"]))[1]
        fitted: dict[str, Any] = {"columns": columns, "offset": {}, "width": 0, "size": {}, "tables": [], "flags": []}
        model = CategoryEncoderModel()
        if columns:
            fill = _fill_values(df, columns, config)
            fitted["fill"] = fill
            if config.get("add_indicator", False):
                missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
                fitted["flags"] = [c for c in columns if missing[c]]
            filled = df.select(*[F.coalesce(value_text(df, c), F.lit(fill[c])).alias(c) for c in columns])
            table = materialize(
                category_slots(filled, columns, "", config.get("min_frequency"), config.get("max_categories"))
            )
            per = table.groupBy("column").agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("b"), (F.max("slot") + 1).alias("k")
            )
            sizes = {r["column"]: r for r in per.collect()}
            for c in columns:
                fitted["offset"][c] = fitted["width"]
                fitted["size"][c] = [sizes[c]["n"], sizes[c]["b"]] if c in sizes else [0, 0]
                fitted["width"] += sizes[c]["k"] if c in sizes else 0
            fitted["tables"] = ["slots"]
            model.tables = {"slots": table.select("column", "value", "slot")}
        return model._with(own, fitted)


def _fill_values(df: DataFrame, columns: Sequence[str], config: Mapping[str, Any]) -> dict[str, str]:
    strategy = config.get("strategy", "constant")
    if strategy == "constant":
        return {c: str(config.get("fill_value", "missing")) for c in columns}
    if strategy != "most_frequent":
        raise ValueError(f"unsupported imputation: {strategy}")
    out = {}
    for c in columns:
        top = category_shares(df, c).orderBy(F.desc("n"), "value").limit(1).first()
        out[c] = top["value"] if top else "missing"
    return out


class CategoryEncoderModel(_TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        own, fitted = self.get_settings(), self.get_fitted()
        known = set(df.columns)
        text = {c: value_text(df, c) if c in known else F.lit(None).cast("string") for c in fitted["columns"]}
        wide = df.select("*", *[F.coalesce(text[c], F.lit(fitted["fill"][c])).alias(f"_v{i}") for i, c in enumerate(text)])
        small, slots = within_budget(fitted["size"]), []
        for i, c in enumerate(fitted["columns"]):
            table = self.tables["slots"].where(F.col("column") == c).select(
                F.col("value").alias(f"_v{i}"), (F.col("slot") + F.lit(fitted["offset"][c])).alias(f"_s{i}")
            )
            wide = wide.join(F.broadcast(table) if c in small else table, f"_v{i}", "left")
            slots.append(F.col(f"_s{i}"))
        for j, c in enumerate(fitted["flags"]):
            missing = F.col(c).isNull() if c in known else F.lit(True)
            slots.append(F.when(missing, F.lit(fitted["width"] + j)))
        hot = F.array(*slots) if slots else F.array().cast("array<int>")
        wide = one_hot(wide.select(*df.columns, hot.alias("_hot")), F.col("_hot"), fitted["width"] + len(fitted["flags"]), own["output"])
        return wide.drop("_hot")


def one_hot(df: DataFrame, slots: Column, width: int, output: str) -> DataFrame:
    """Sparse vector with ones at the given slots (built on the JVM side)."""
    if not width:
        return df.select("*", sized_vector(array_to_vector(F.array().cast("array<double>")), 0, output))
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(width)], "_slots", output)
    marked = df.withColumn("_slots", F.transform(F.array_compact(slots), lambda x: x.cast("string")))
    return model.transform(marked).drop("_slots")


# -- selection ----------------------------------------------------------------------------


# Classes whose moments the driver may hold: a vector of the width of the features each.
MAX_CLASSES = 1_000


def _check_classes(df: DataFrame, target: str) -> None:
    if df.select(target).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"column {target!r} has more than {MAX_CLASSES} values: not a class for an analysis of variance")


def class_moments(df: DataFrame, vector: str, target: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, mean, variance) of a vector column per class: one aggregation. Raises on a target that is no class."""
    _check_classes(df, target)
    found = df.groupBy(target).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col(vector)).alias("s")
    ).select("s.count", "s.mean", "s.variance").collect()
    return [(r["count"], r["mean"].toArray(), r["variance"].toArray()) for r in found]


def anova_f(moments: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(F score, population variance) of every feature from per-class moments."""
    counts = np.array([m[0] for m in moments], dtype=float)[:, None]
    means, variances = np.array([m[1] for m in moments]), np.array([m[2] for m in moments])
    rows, classes = counts.sum(), len(moments)
    overall = (counts * means).sum(axis=0) / rows
    between = (counts * (means - overall) ** 2).sum(axis=0)
    within = (np.maximum(counts - 1, 0) * variances).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (between / max(classes - 1, 1)) / (within / max(rows - classes, 1))
    return score, (between + within) / rows


def anova_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``column, f_score`` of plain numeric columns, from per-class sums. Raises on a target that is no class."""
    _check_classes(df, target)
    data = df.select(F.col(target).alias("_y"), *[to_number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    per_class = data.groupBy("_y").agg(
        *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(columns))
          for k, f in (("n", F.count), ("a", F.avg), ("v", F.var_samp))]
    ).collect()
    rows = []
    for i, c in enumerate(columns):
        moments = [(r[f"n{i}"], np.array([r[f"a{i}"]]), np.array([r[f"v{i}"] or 0.0])) for r in per_class if r[f"n{i}"]]
        score, _ = anova_f(moments)
        rows.append((c, float(score[0])))
    return df.sparkSession.createDataFrame(rows, "column string, f_score double")


class FeatureSelector(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Drop constant features, then keep the k with the highest ANOVA F."""

    def __init__(self, k: int | str | None = None, drop_constant: bool = True, target: str = "label",
                 vector: str = "assembled", output: str = "features"):
        super().__init__()
        self._with({"k": k, "drop_constant": drop_constant, "target": target, "vector": vector, "output": output}, {})

    def _fit(self, df: DataFrame) -> VectorSlicer:
        own = self.get_settings()
        score, variance = anova_f(class_moments(df, own["vector"], own["target"]))
        keep = np.flatnonzero(variance > 0) if own["drop_constant"] else np.arange(len(variance))
        if not len(keep):
            raise ValueError("no feature varies")
        if own["k"] not in (None, "all"):
            ranked = np.nan_to_num(score[keep], nan=-1.0, posinf=np.inf)
            best = np.argsort(-ranked, kind="stable")[: min(int(own["k"]), len(keep))]
            keep = np.sort(keep[best])
        return VectorSlicer(inputCol=own["vector"], outputCol=own["output"], indices=[int(i) for i in keep])


class WrittenOnce(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage that, while the pipeline is fitted, writes the rows so far as a table from which all later stages read. The fitted
    stage passes any other rows through."""

    def _fit(self, df: DataFrame) -> PassThrough:
        return PassThrough(df, materialize(df))


class PassThrough(Model, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, seen: DataFrame | None = None, written: DataFrame | None = None):
        super().__init__()
        self._seen, self._written = seen, written

    def _transform(self, df: DataFrame) -> DataFrame:
        if df is not self._seen:
            return df
        written, self._seen, self._written = self._written, None, None  # once, for the rows it was fitted on
        return written


def build_preprocessing(settings: Mapping[str, Any], target: str, carried: Sequence[str] = (), output: str = "features") -> Pipeline:
    """Engineer, impute/scale/encode, expand, drop constants, select: one Pipeline.

    ``carried`` columns (id, fold, weight) pass through and are no features.
    """
    s = settings
    excluded = [target, *carried]
    stages: list[Any] = []
    engineered = s.get("use_feature_engineering", False)
    if engineered:
        stages += [FeatureEngineer(s, target, carried), WrittenOnce()]
    stages.append(
        NumericPrep(
            {"strategy": s.get("numeric_imputer_strategy", "median"), "scaler": s.get("scaler"),
             "add_indicator": s.get("numeric_add_missing_indicator", False)},
            excluded=excluded,
        )
    )
    stages.append(
        CategoryEncoder(
            {"strategy": s.get("categorical_imputer_strategy", "constant"), "fill_value": s.get("categorical_fill_value", "missing"),
             "add_indicator": s.get("categorical_add_missing_indicator", False),
             "min_frequency": s.get("encoder_min_frequency"), "max_categories": s.get("encoder_max_categories")},
            excluded=[*excluded, "numeric_vector"],
        )
    )
    expanded, selected = s.get("use_polynomial_features", False), s.get("use_variance_threshold", False) or s.get("use_feature_selection", False)
    last = "assembled" if expanded or selected else output
    stages.append(VectorAssembler(inputCols=["numeric_vector", "category_vector"], outputCol=last))
    if expanded:
        last = "expanded" if selected else output
        stages.append(PolynomialExpansion(degree=int(s.get("polynomial_degree", 2)), inputCol="assembled", outputCol=last))
    if selected:
        k = s.get("feature_selection_k") if s.get("use_feature_selection", False) else None
        stages.append(FeatureSelector(k, s.get("use_variance_threshold", False), target, last, output))
    return Pipeline(stages=stages)
