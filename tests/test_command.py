"""The command line, end to end on one small table."""

from __future__ import annotations

import copy

import pytest

from millrace.__main__ import main, parser
from millrace.plans.catalog_quality import CONFIG
from millrace.plans.catalog_training import COLUMNS, JOB
from millrace.plans.monitoring import moves
from millrace.sources import tables

yaml = pytest.importorskip("yaml")


@pytest.fixture()
def work(spark, txn, tmp_path):
    tables.write_table(txn, str(tmp_path / "t.parquet"))
    tables.write_table(txn.select(*COLUMNS), str(tmp_path / "f.parquet"))
    settings = copy.deepcopy(JOB)
    settings["data"].update(
        raw_transaction_path=str(tmp_path / "f.parquet"), test_size=0.2, processed_path=str(tmp_path / "p.parquet"),
        train_path=str(tmp_path / "train.parquet"), test_path=str(tmp_path / "test.parquet"),
    )
    settings["artifacts"] = {"best_model_path": str(tmp_path / "model"), "results_path": str(tmp_path / "results"),
                             "preprocessing_pipeline_path": str(tmp_path / "prep")}
    settings["monitoring"] = {"sample_size": 300, "drifted_numeric_columns": ["txn_amt"], "numeric_multiply": {"txn_amt": 4.0},
                              "drifted_categorical_columns": ["card6"]}
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(settings))
    limits = {**copy.deepcopy(CONFIG), "model_validation": {"min_accuracy": 1.5}}
    limits["drift"] = {"numeric_columns": ["txn_amt"], "categorical_columns": ["card6"]}
    (tmp_path / "v.yaml").write_text(yaml.safe_dump(limits))
    return tmp_path


def test_jobs(spark, work, capsys):
    run = lambda *a: main([*a], spark)
    s, v = str(work / "s.yaml"), str(work / "v.yaml")
    assert run("validate", "--config", v, "--input", str(work / "t.parquet"), "--output", str(work / "r")) == 1
    assert "missing_value_threshold" in capsys.readouterr().out
    assert run("prepare", "--config", s) == 0 and run("split", "--config", s) == 0
    assert run("featurize", "--config", s) == 0 and tables.path_exists(spark, str(work / "prep"))
    assert run("train", "--config", s) == 0
    assert run("evaluate", "--config", s, "--validation-config", v) == 1
    assert run("monitor", "--config", s, "--validation-config", v, "--output", str(work / "m")) == 0
    rows = {r["report"]: r for r in spark.read.json(str(work / "m/summary.json")).collect()}
    assert rows["drift"]["number_of_columns"] == 4


def test_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["fly", "--config", "x"])


def test_moves():
    assert moves({"amount_drift_multiplier": 3, "card1_shift": 5, "numeric_shift": {"card1": 9.0}}) == ({"TransactionAmt": 3.0}, {"card1": 9.0})
