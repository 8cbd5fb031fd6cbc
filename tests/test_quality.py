from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.config import SAMPLE_PARAMS, SAMPLE_VALIDATION, ConfigError, load_config
from millrace.operators import contract, quality
from millrace.operators.profile import (
    column_types, configured_columns, correlations, feature_projection, numeric_profile, overview, value_shares,
)
from millrace.operators.quality import duplicate_summary
from millrace.session import materialize

# Amounts and product codes of a small clean sample with a known profile.
AMOUNTS = [
    68.5, 29.0, 125.7, 42.25, 18.9, 310.0, 74.2, 55.0, 21.4, 450.12, 85.73, 12.0, 33.8, 205.45, 47.0, 96.3, 39.99, 520.0, 26.4, 111.1,
    64.7, 275.25, 72.35, 14.49, 58.8, 605.0, 82.6, 37.2, 49.9, 355.5, 19.75, 92.45, 66.6, 480.0, 24.2, 130.0, 71.25, 225.0, 43.1, 99.99,
]
CODES = "WWCWRCHWSCWRWCHWSCWRWCHWSCWRWCHWSCWRWCHW"


@pytest.fixture(scope="module")
def sample(spark):
    networks = ["visa", "mastercard", "discover", "american express"]
    rows = [
        (1000001 + i, int(c == "C"), 86400.0 + 1300 * i, a, c, 1675.0 + 400 * i, networks[i % 4], "credit" if c == "C" else "debit",
         "gmail.com", f"2026-05-04T{8 + i // 15:02d}:{i % 15 * 4:02d}:00Z")
        for i, (a, c) in enumerate(zip(AMOUNTS, CODES))
    ]
    return spark.createDataFrame(
        rows,
        "TransactionID bigint, isFraud int, TransactionDT double, TransactionAmt double, ProductCD string, card1 double, card4 string, "
        "card6 string, P_emaildomain string, ingestion_timestamp string",
    )


def test_profile_of_the_sample(sample):
    row = numeric_profile(sample, ["TransactionAmt"]).first()
    assert (row["count"], row["min"], row["max"], row["missing_fraction"]) == (40, 12.0, 605.0, 0.0)
    assert row["mean"] == pytest.approx(131.02425) and row["std"] == pytest.approx(151.04752328)
    assert row["q05"] == pytest.approx(18.6795) and row["q99"] == pytest.approx(571.85)


def test_shares_of_the_sample(sample):
    shares = {r["value"]: r["share"] for r in value_shares(sample, "ProductCD").collect()}
    assert shares == pytest.approx({"W": 0.4, "C": 0.25, "H": 0.125, "R": 0.125, "S": 0.1})


def test_clean_sample_passes(sample):
    issues, metrics = quality.build_suite(SAMPLE_VALIDATION).run(sample)
    assert issues == []
    assert list(metrics) == ["missing_values", "duplicates", "unexpected_categories", "outliers", "class_balance", "freshness"]
    table, broken = contract.check_contract(sample, SAMPLE_VALIDATION["schema"], "TransactionID")
    assert broken == [] and dict(table.dtypes)["isFraud"] == "bigint"


def test_infinite_values_are_not_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    row = numeric_profile(df, ["x"]).first()
    assert (row["count"], row["missing_fraction"], row["max"]) == (1, 0.5, 1.0)


def test_nulls(spark):
    df = spark.createDataFrame([(10.0,), (None,), (None,), (15.0,)], "amount double")
    issues, metrics = quality.check_nulls(df, {"amount": 0.25, "absent": 0.0})
    assert [i.check for i in issues] == ["missing_value_threshold"] and metrics["amount"]["missing_fraction"] == 0.5
    assert list(metrics) == ["amount"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "id int, x string")
    issues, metrics = quality.check_duplicates(df, ["id"], 0.0)
    assert metrics["duplicate_count"] == 4 and issues[0].severity == "error"
    assert quality.check_duplicates(df, [], 0.0)[1]["duplicate_count"] == 0
    assert quality.check_duplicates(df, ["gone"])[0][0].details == {"missing_columns": ["gone"]}
    assert quality.check_duplicates(df.limit(0), ["id"]) == ([], {"duplicate_count": 0, "duplicate_fraction": 0.0, "subset": ["id"]})


def test_categories_are_listed_up_to_a_length(spark):
    df = spark.createDataFrame([(f"v{i:02d}",) for i in range(40)] + [("ok",), (None,)], "c string")
    issues, metrics = quality.check_categories(df, {"c": ["ok"]}, "warning")
    assert metrics["c"]["unexpected_count"] == 40 and len(metrics["c"]["unexpected_values"]) == 25
    assert issues[0].severity == "warning" and "v09" in issues[0].message and "v10" not in issues[0].message


def test_outliers_fall_back_to_the_mean(spark):
    df = spark.createDataFrame([(5.0, 1.0)] * 40 + [(500.0, 1.0)], "x double, flat double")
    issues, metrics = quality.check_outliers(df, {"columns": ["x", "flat"], "robust_zscore_threshold": 5.0, "max_fraction": 0.01})
    assert metrics["x"]["outlier_count"] == 1 and metrics["flat"]["outlier_count"] == 0
    assert [i.column for i in issues] == ["x"]
    few = quality.check_outliers(df.limit(9), {"columns": ["x"]})[1]
    assert few["x"]["checked"] is False


def test_balance(spark):
    df = spark.createDataFrame([(0,)] * 99 + [(1,), (None,)], "y int")
    issues, metrics = quality.check_balance(df, "y", 0.02)
    assert metrics["minority_ratio"] == 0.01 and metrics["class_counts"] == {"0": 99, "1": 1} and len(issues) == 1
    assert quality.check_balance(df.where("y = 0"), "y")[0][0].severity == "warning"
    assert quality.check_balance(df, "z") == ([], {"checked": False, "reason": "target_column_missing"})


def test_balance_lists_all_of_2000_classes(spark):
    issues, metrics = quality.check_balance(spark.range(6000).select((F.col("id") % 2000).alias("y")), "y", 0.0001)
    assert issues == [] and len(metrics["class_counts"]) == 2000 and set(metrics["class_counts"].values()) == {3}


def test_freshness(spark):
    df = spark.createDataFrame([("2026-05-01T00:00:00Z",), ("2026-05-20",), ("soon",), (None,)], "ts string")
    settings = {"timestamp_column": "ts", "reference_time": "2026-05-07T00:00:00Z", "max_age_days": 10}
    issues, metrics = quality.check_freshness(df, settings)
    assert [i.check for i in issues] == ["invalid_timestamp", "future_timestamp"]
    assert metrics["invalid_timestamp_fraction"] == round(1 / 3, 6) and metrics["future_timestamp_fraction"] == 0.5
    stale, _ = quality.check_freshness(df.limit(1), {**settings, "max_age_days": 3, "fail_on_stale": False})
    assert [(i.check, i.severity) for i in stale] == [("data_freshness", "warning")]
    absent, _ = quality.check_freshness(df, {"timestamp_column": "no", "required": True})
    assert absent[0].severity == "error"


def test_registered_check_runs_last(spark, sample):
    def few_rows(df):
        n = df.count()
        return [quality.Issue("row_count", "error", f"only {n} rows")] if n < 100 else [], {"rows": n}

    issues, metrics = quality.build_suite(SAMPLE_VALIDATION).register("rows", few_rows).run(sample)
    assert [i.check for i in issues] == ["row_count"] and metrics["rows"] == {"rows": 40}
    assert quality.gate(quality.issues_frame(spark, issues)).first()["passed"] is False


def test_gate_on_warnings(spark):
    table = quality.issues_frame(spark, [quality.Issue("a", "warning", "m")])
    assert quality.gate(table).first()["passed"] is True
    assert quality.gate(table, fail_on_warnings=True).first()["passed"] is False


def test_contract_rules(spark):
    df = spark.createDataFrame(
        [(1, "12", "x", 1.5), (2, "a", None, 2.0), (3, None, "zz", 99.0)], "id bigint, n string, c string, f double"
    )
    rules = {
        "required_columns": [
            {"name": "id", "dtype": "int"}, {"name": "n", "dtype": "float", "nullable": False}, {"name": "c", "dtype": "string", "nullable": True},
            {"name": "f", "dtype": "int"}, {"name": "gone", "dtype": "int"},
        ],
        "numeric_ranges": {"f": {"min": 0, "max": 50}, "n": {"max": 10}},
        "categorical_allowed_values": {"c": ["x"]},
    }
    counts = {(r["column"], r["check"]): r["n"] for r in contract.violation_counts(df, rules).collect() if r["n"]}
    assert counts == {("n", "dtype"): 1, ("n", "not_nullable"): 1, ("n", "max"): 1, ("c", "allowed"): 1, ("f", "dtype"): 1, ("f", "max"): 1}
    table, issues = contract.check_contract(df, rules, "id")
    assert table.columns == df.columns and len(issues) == 7
    assert contract.layout_failures(df, rules) == [("gone", "column_present")]
    with pytest.raises(ValueError):
        contract.spark_type("decimal")


def test_contract_layout(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, a int, x int")
    rules = {"required_columns": [{"name": "a"}, {"name": "b"}], "strict": True, "ordered": True}
    assert ("x", "column_known") in contract.layout_failures(df, rules)
    assert ("b", "column_order") in contract.layout_failures(df, rules)


def test_failures_beyond_the_list_are_counted(spark):
    df = spark.range(100).selectExpr("id", "CAST(NULL AS DOUBLE) AS x")
    _, issues = contract.check_contract(df, {"required_columns": [{"name": "x", "dtype": "float"}]}, "id")
    assert len(issues) == 31 and issues[-1].details == {"additional_failure_cases": 70}


def test_column_choice(spark):
    df = spark.createDataFrame([(1.0, 2, "v", "g", True)], "amount double, count int, card_type string, email string, flag boolean")
    assert column_types(df, ["count"]) == (["amount", "flag"], ["count", "card_type", "email"])
    assert configured_columns(df, ["count", "no"], True) == ["count"]
    assert configured_columns(df, ["no"], False) == ["card_type", "email"]
    assert overview(df) == {"rows": 1, "columns": 5, "numeric_columns": 3, "other_columns": 2}
    with pytest.raises(ValueError):
        feature_projection(df, "isFraud")


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("drift:\n  enabled: false\n")
    assert load_config(path) == {"drift": {"enabled": False}}
    with pytest.raises(ConfigError):
        load_config({"data": {}}, ("data", "models"))
    with pytest.raises(ConfigError):
        load_config(tmp_path / "none.yaml")
    copy = load_config(SAMPLE_PARAMS)
    copy["data"]["test_size"] = 0.5
    assert SAMPLE_PARAMS["data"]["test_size"] == 0.2


def counted_rows(spark, df):
    """The frame, and an accumulator of the rows read from it: their number over the frame's is the number of scans."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def wide_frame(spark, rows, columns, seed=4):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame(rng.lognormal(2, 1, (rows, columns)) + np.arange(columns) * 1e4, columns=[f"c{i}" for i in range(columns)])
    data["c1"] = data["c0"] * -2 + rng.random(rows)
    data["c2"] = 7.0
    for c in data.columns[3::5]:
        data.loc[rng.random(rows) < 0.3, c] = np.nan
    data["c4"] = np.nan
    data.loc[0, "c4"] = 1.0
    saved = materialize(spark.createDataFrame(data).repartition(6))
    return saved, data


def test_wide_profile_takes_two_scans(spark):
    df, data = wide_frame(spark, 700, 432)
    data["c9"] = data["c9"].round(-1)  # ties across brackets
    df = df.withColumn("c9", F.round("c9", -1)).withColumn("c8", F.lit(None).cast("double"))
    counted, seen = counted_rows(spark, df)
    found = {r["column"]: r for r in numeric_profile(counted, df.columns).collect()}
    assert seen.value == 2 * 700 and len(found) == 432
    assert found["c8"]["count"] == 0 and found["c8"]["missing_fraction"] == 1 and found["c8"]["q50"] is None
    for c in ("c0", "c2", "c3", "c4", "c9", "c431"):
        x = data[c].dropna()
        r = found[c]
        assert r["count"] == len(x) and r["missing_fraction"] == pytest.approx(data[c].isna().mean(), abs=1e-6)
        assert [r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([x.mean(), x.std(ddof=0), x.min(), x.max()])
        assert [r[q] for q in ("q01", "q05", "q50", "q95", "q99")] == pytest.approx(list(np.quantile(x, [0.01, 0.05, 0.5, 0.95, 0.99])))


def test_column_statistics_survive_a_bad_sketch(spark, monkeypatch):
    from millrace.operators import ordered

    df, data = wide_frame(spark, 300, 6)
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda c, points, accuracy: F.array(*[F.max(c)] * len(points)))
    found = ordered.column_statistics(df, df.columns, [0.25, 0.5], task_rows=50)
    for c in df.columns:
        assert found[c]["quantiles"] == pytest.approx(list(np.quantile(data[c].dropna(), [0.25, 0.5])))


def test_correlations_of_400_columns_in_one_scan(spark):
    df, data = wide_frame(spark, 600, 400)
    counted, seen = counted_rows(spark, df)
    found = {(r["left"], r["right"]): r["corr"] for r in correlations(counted, df.columns).collect()}
    assert seen.value == 600 and len(found) == 400 * 399 // 2
    want = data.corr(min_periods=2)
    for (a, b), value in list(found.items())[::97] + [((a, b), found[a, b]) for a, b in (("c0", "c1"), ("c0", "c2"), ("c0", "c4"), ("c3", "c8"))]:
        expected = want.loc[a, b]
        assert value is None if expected != expected else value == pytest.approx(expected, abs=1e-9)
    assert found["c0", "c1"] < -0.99 and found["c0", "c2"] is None and found["c0", "c4"] is None


@pytest.mark.parametrize("weak", [False, True])
def test_whole_row_duplicates_by_fingerprints(spark, weak):
    """Rows equal in all columns, NULLs included; also with a fingerprint that collides all the time."""
    from millrace.operators import joins

    rng = np.random.default_rng(6)
    rows = [(int(a), None if b == 3 else f"v{b}", float(a) / 2 if b else None, bool(b % 2), None) for a, b in rng.integers(0, 7, (300, 2))]
    rows += [(None, "1", None, None, None), (1, None, None, None, None), (99, "hot", 0.0, True, None), *[(98, "hot", -0.0 if i % 2 else 0.0, True, None) for i in range(150)]]
    df = spark.createDataFrame(rows, "a int, b string, c double, d boolean, e string").repartition(5)
    count = Counter(rows)
    want = sum(n for n in count.values() if n > 1)
    prints = (lambda columns: [F.pmod(F.hash(columns[0]), F.lit(2))]) if weak else joins.fingerprint
    some, total = joins.possible_duplicates(df, df.columns, prints)
    assert total == len(rows) and some.columns == df.columns and some.count() >= want and (weak or some.count() == want)
    assert tuple(duplicate_summary(df, df.columns).first()) == (len(rows), want)
    assert Counter(map(tuple, joins.duplicate_members(df, df.columns).collect())) == Counter({r: n for r, n in count.items() if n > 1})
    assert sum(r["n"] for r in joins.count_duplicates(df, df.columns).collect()) == want
    assert tuple(duplicate_summary(df.where("a < 0"), df.columns).first()) == (0, 0)


def test_many_classes_become_a_table(spark, monkeypatch):
    from millrace.operators import encoders, quality

    df = spark.range(60).select((F.col("id") % 20).cast("string").alias("y"), (F.col("id") * 1.0).alias("x"))
    monkeypatch.setattr(quality, "TARGET_CLASSES_LISTED", 10)
    _, metrics = quality.check_balance(df, "y")
    assert "class_counts" not in metrics and {r["n"] for r in spark.read.parquet(metrics["class_counts_table"]).collect()} == {3}
    monkeypatch.setattr(encoders, "MAX_CLASSES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        encoders.anova_scores(df, ["x"], "y")
