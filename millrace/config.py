"""Settings: a mapping, or a YAML file when PyYAML is there."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

# The sample contract, limits and model settings for card
# transactions. Functions take their own defaults; this is the shipped example.
SAMPLE_VALIDATION: dict[str, Any] = {
    "validation": {
        "dataset_name": "card_transactions",
        "target_column": "isFraud",
        "id_column": "TransactionID",
        "create_baseline_if_missing": True,
        "fail_on_warnings": False,
    },
    "schema": {
        "strict": False,
        "coerce": True,
        "ordered": False,
        "required_columns": [
            {"name": "TransactionID", "dtype": "int", "nullable": False},
            {"name": "isFraud", "dtype": "int", "nullable": False},
            {"name": "TransactionDT", "dtype": "float", "nullable": False},
            {"name": "TransactionAmt", "dtype": "float", "nullable": False},
            {"name": "ProductCD", "dtype": "string", "nullable": False},
            {"name": "card1", "dtype": "float", "nullable": False},
            {"name": "card4", "dtype": "string", "nullable": True},
            {"name": "card6", "dtype": "string", "nullable": True},
            {"name": "P_emaildomain", "dtype": "string", "nullable": True},
        ],
        "numeric_ranges": {
            "TransactionID": {"min": 1, "max": 1000000000},
            "isFraud": {"min": 0, "max": 1},
            "TransactionDT": {"min": 0, "max": 100000000},
            "TransactionAmt": {"min": 0.01, "max": 50000.0},
            "card1": {"min": 1000, "max": 20000},
        },
        "categorical_allowed_values": {
            "ProductCD": ["W", "C", "R", "H", "S"],
            "card4": ["visa", "mastercard", "american express", "discover"],
            "card6": ["credit", "debit", "charge card", "debit or credit"],
            "P_emaildomain": [
                "gmail.com", "yahoo.com", "hotmail.com", "anonymous.com", "aol.com", "comcast.net", "outlook.com",
            ],
        },
        "null_thresholds": {
            "TransactionID": 0.0, "isFraud": 0.0, "TransactionDT": 0.0, "TransactionAmt": 0.0, "ProductCD": 0.0,
            "card1": 0.0, "card4": 0.20, "card6": 0.20, "P_emaildomain": 0.25,
        },
    },
    "quality": {
        "duplicates": {"subset": ["TransactionID"], "max_fraction": 0.0},
        "unexpected_categories": {"fail": True},
        "outliers": {
            "enabled": True, "fail": False, "columns": ["TransactionAmt", "TransactionDT", "card1"],
            "robust_zscore_threshold": 8.0, "max_fraction": 0.05,
        },
        "class_imbalance": {"target_column": "isFraud", "min_minority_ratio": 0.02},
        "freshness": {
            "enabled": True, "required": False, "timestamp_column": "ingestion_timestamp",
            "reference_time": "2026-05-07T00:00:00Z", "max_age_days": 10, "max_invalid_fraction": 0.0,
            "max_future_days": 1, "max_future_fraction": 0.0, "fail_on_stale": True,
        },
    },
    "drift": {
        "enabled": True,
        "fail_on_distribution_drift": False,
        "min_samples": 20,
        "numeric_columns": ["TransactionAmt", "TransactionDT", "card1"],
        "categorical_columns": ["ProductCD", "card4", "card6", "P_emaildomain"],
        "ks_pvalue_threshold": 0.001,
        "ks_statistic_threshold": 0.25,
        "categorical_js_threshold": 0.20,
        "max_mean_shift_std": 3.0,
        "schema_drift": {"track": "required", "fail_on_missing_columns": True, "fail_on_new_columns": False},
    },
    "model_validation": {
        "min_accuracy": 0.95, "min_precision": 0.70, "min_recall": 0.45, "min_f1": 0.60, "min_roc_auc": 0.85,
        "min_average_precision": 0.55,
    },
}

SAMPLE_PARAMS: dict[str, Any] = {
    "data": {
        "target_column": "isFraud", "id_column": "TransactionID", "sample_size": None, "test_size": 0.2,
        "random_state": 42,
    },
    "preprocessing": {
        "numeric_imputer_strategy": "median",
        "categorical_imputer_strategy": "constant",
        "categorical_fill_value": "missing",
        "numeric_add_missing_indicator": True,
        "categorical_add_missing_indicator": False,
        "scaler": "robust",
        "encoder_max_categories": 75,
        "encoder_min_frequency": 5,
        "use_feature_engineering": True,
        "amount_column": "TransactionAmt",
        "log_transform_features": ["TransactionAmt"],
        "use_transaction_time_features": True,
        "transaction_time_column": "TransactionDT",
        "categorical_like_numeric_features": ["card1", "card2", "card3", "card5", "addr1", "addr2"],
        "use_missing_pattern_features": True,
        "missing_indicator_prefixes": ["card", "addr", "dist", "C", "D", "V", "M", "id_"],
        "use_frequency_encoding": True,
        "frequency_encode_features": [
            "card1", "card2", "card3", "card5", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceInfo",
            "id_30", "id_31", "id_33",
        ],
        "use_amount_group_features": True,
        "amount_groupby_features": ["ProductCD", "card1", "card4", "card6", "addr1", "P_emaildomain"],
        "use_target_mean_encoding": True,
        "target_mean_smoothing": 30.0,
        "target_mean_encode_features": [
            "ProductCD", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "P_emaildomain",
            "R_emaildomain", "DeviceType", "DeviceInfo", "id_30", "id_31", "id_33",
        ],
        "target_mean_encode_interactions": [
            ["card1", "addr1"], ["card1", "ProductCD"], ["card4", "card6"], ["P_emaildomain", "R_emaildomain"],
        ],
        "email_domain_features": ["P_emaildomain", "R_emaildomain"],
        "email_match_features": ["P_emaildomain", "R_emaildomain"],
        "interaction_features": [
            ["card1", "addr1"], ["card1", "ProductCD"], ["card4", "card6"], ["P_emaildomain", "R_emaildomain"],
        ],
        "use_smote": False,
        "smote_sampling_strategy": 0.5,
        "smote_k_neighbors": 5,
        "smote_random_state": 42,
        "use_variance_threshold": True,
        "use_feature_selection": True,
        "feature_selection_k": 1500,
        "use_polynomial_features": False,
        "polynomial_degree": 2,
    },
    "training": {
        "scoring_metric": "f1",
        "cv_folds": 2,
        "n_jobs": 2,
        "threshold_tuning": True,
        "threshold_metric": "f1",
        "threshold_grid": [
            0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85,
            0.90, 0.95,
        ],
    },
    "monitoring": {
        "sample_size": 5000,
        "random_state": 42,
        "max_report_features": 20,
        "drift_alert_share_threshold": 0.20,
        "drifted_numeric_columns": ["TransactionAmt", "TransactionDT", "card1"],
        "drifted_categorical_columns": ["ProductCD", "P_emaildomain", "card4"],
        "numeric_multiply": {"TransactionAmt": 4.0},
        "numeric_shift": {"TransactionDT": 1209600.0, "card1": 5000.0},
        "categorical_drift_fraction": 0.75,
        "categorical_replacements": {"ProductCD": "C", "P_emaildomain": "drifted.example.com", "card4": "visa"},
    },
}


class ConfigError(ValueError):
    """The settings cannot be used."""


def load_config(source: Mapping[str, Any] | str | Path, required: tuple[str, ...] = ()) -> dict[str, Any]:
    """Settings from a mapping or a YAML file, with the named sections present."""
    if isinstance(source, Mapping):
        loaded: Any = copy.deepcopy(dict(source))
    else:
        if yaml is None:
            raise ConfigError("PyYAML is needed to read a settings file")
        path = Path(source)
        if not path.exists():
            raise ConfigError(f"settings file not found: {path}")
        loaded = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    missing = sorted(set(required) - set(loaded))
    if missing:
        raise ConfigError(f"settings lack the sections {missing}")
    return loaded
