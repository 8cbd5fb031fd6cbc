from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.functions import expr
from millrace.operators import encoders
from millrace.plans.catalog_features import PREPROCESSING, SETTINGS

CONFIG = {
    "use_feature_engineering": True,
    "log_transform_features": ["TransactionAmt"],
    "use_transaction_time_features": True,
    "categorical_like_numeric_features": ["card1"],
    "use_missing_pattern_features": True,
    "missing_indicator_prefixes": ["card", "addr", "zz"],
    "use_frequency_encoding": True,
    "frequency_encode_features": ["card1", "absent"],
    "use_amount_group_features": True,
    "amount_groupby_features": ["ProductCD"],
    "use_target_mean_encoding": True,
    "target_mean_smoothing": 2.0,
    "target_mean_encode_features": ["ProductCD"],
    "target_mean_encode_interactions": [["card4", "card6"], ["card4"]],
    "email_domain_features": ["P_emaildomain"],
    "interaction_features": [["card4", "card6"], ["card4"]],
}


@pytest.fixture(scope="module")
def three(spark):
    rows = [
        (0, 10.0, 0, "W", 111.0, "visa", "debit", None, "gmail.com", "gmail.com"),
        (1, 20.5, 90000, "W", None, "visa", "credit", 5.0, "yahoo.co.uk", "hotmail.com"),
        (0, None, 7200, "C", 111.0, None, "debit", None, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "isFraud int, TransactionAmt double, TransactionDT bigint, ProductCD string, card1 double, card4 string, card6 string, addr1 double, "
        "P_emaildomain string, R_emaildomain string",
    )


def test_engineered_columns(three):
    model = encoders.FeatureEngineer(CONFIG, "isFraud").fit(three)
    rows = {r["TransactionDT"]: r for r in model.transform(three).collect()}
    a, b, c = rows[0], rows[90000], rows[7200]
    assert [r["email_domain_match"] for r in (a, b, c)] == [1, 0, 0]
    assert (a["TransactionAmt_cents"], b["TransactionAmt_cents"], c["TransactionAmt_cents"]) == (0.0, 50.0, 0.0)
    assert (b["TransactionAmt_is_round"], c["TransactionAmt_is_round"], c["TransactionAmt_log1p"]) == (0, 1, None)
    assert (b["TransactionDT_hour"], b["TransactionDT_weekday"], b["TransactionDT_day"]) == (1.0, 1.0, 90000 / 86400)
    assert c["TransactionDT_hour_sin"] == pytest.approx(math.sin(2 * math.pi * 2 / 24))
    assert (a["missing_total_count"], c["missing_total_count"]) == (1, 5) and c["missing_total_ratio"] == pytest.approx(5 / 9)
    assert (b["card_missing_count"], a["addr_missing_ratio"]) == (1, 1.0) and "zz_missing_count" not in a
    assert a["card1"] == "111.0" and b["card1"] is None
    assert a["card1_frequency"] == pytest.approx(2 / 3) and b["card1_frequency"] == pytest.approx(1 / 3)
    assert a["ProductCD_target_mean"] == pytest.approx((1 + 2 / 3) / 4)
    assert c["card4_x_card6_target_mean"] == pytest.approx((0 + 2 / 3) / 3) and c["card4_x_card6"] == "__missing___debit"
    assert a["TransactionAmt_to_ProductCD_median"] == pytest.approx(10 / 15.25) and c["TransactionAmt_to_ProductCD_median"] is None
    assert (b["P_emaildomain_root"], b["P_emaildomain_suffix"], c["P_emaildomain_root"]) == ("yahoo", "uk", "__missing__")


def test_unseen_values_get_the_defaults(three):
    model = encoders.FeatureEngineer(CONFIG, "isFraud").fit(three.where("ProductCD = 'W'"))
    row = model.transform(three.where("ProductCD = 'C'")).first()
    assert row["ProductCD_target_mean"] == 0.5 and row["TransactionAmt_minus_ProductCD_median"] is None
    assert row["card1_frequency"] == 0.5


def test_identity_without_engineering(three):
    model = encoders.FeatureEngineer({**CONFIG, "use_feature_engineering": False}, "isFraud").fit(three)
    assert model.transform(three).columns == three.columns


def test_scaled_columns_have_mean_zero(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, 4.0, 5.0), (6.0, 8.0, 5.0)], "a double, b double, flat double")
    fitted = encoders.fit_numeric(df, ["a", "b", "flat"], {"scaler": "standard", "add_indicator": True})
    out = df.select(*[c.alias(n) for n, c in encoders.numeric_outputs(df, fitted).items()]).toPandas()
    assert list(out.columns) == ["a", "b", "flat", "b_missing"] and not out.isna().any().any()
    assert np.allclose(out.mean(), 0) and set(out["flat"]) == {0.0}


def test_imputation_strategies(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (10.0,), (None,)], "x double").withColumn("gone", F.lit(None).cast("double"))
    fill = lambda s: encoders.fit_numeric(df, ["x", "gone"], {"strategy": s})["fill"]
    assert fill("median") == {"x": 3.0} and fill("mean") == {"x": 5.2} and fill("most_frequent") == {"x": 10.0}
    for bad in ({"strategy": "knn"}, {"scaler": "minmax"}):
        with pytest.raises(ValueError):
            encoders.fit_numeric(df, ["x"], bad)


def test_robust_scale_without_spread(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "x double")
    fitted = encoders.fit_numeric(df, ["x"], {"scaler": "robust"})
    assert fitted["scale"] == {"x": 1.0} and fitted["center"] == {"x": 1.0}


def test_one_hot(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [("c",), (None,)], "x string")
    model = encoders.CategoryEncoder({"fill_value": "missing", "min_frequency": 2}, ["x"]).fit(df)
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("new",)], "x string")
    out = [list(r["v"]) for r in model.transform(rows).select("x", vector_to_array("category_vector").alias("v")).collect()]
    found = dict(zip(["a", "b", "c", None, "new"], out)) if len(out) == 5 else {}
    shown = {r["x"]: list(r["v"]) for r in model.transform(rows).select("x", vector_to_array("category_vector").alias("v")).collect()}
    assert shown == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], None: [0, 0, 1], "new": [0, 0, 0]} and len(found) == 5
    kind = model.transform(rows).select("category_vector").first()[0]
    assert type(kind).__name__ == "SparseVector"


@pytest.mark.parametrize(("limit", "slots"), [(None, 4), (4, 4), (3, 3), (2, 2)])
def test_category_limit_counts_the_shared_slot(spark, limit, slots):
    df = spark.createDataFrame([(v,) for v, n in zip("abcd", (5, 4, 3, 2)) for _ in range(n)], "x string")
    table = encoders.category_slots(df, ["x"], "missing", None, limit).toPandas()
    assert table["slot"].max() + 1 == slots and len(table) == 4
    assert table[table.value == "a"]["is_infrequent"].tolist() == [False]


def test_selection(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (1, 1, 0.0), (2, 0, 1.0), (3, 0, 1.0)], "a int, b int, label double")
    from pyspark.ml.feature import VectorAssembler

    wide = VectorAssembler(inputCols=["a", "b"], outputCol="assembled").transform(df)
    assert encoders.FeatureSelector(1, False).fit(wide).getIndices() == [1]
    assert encoders.FeatureSelector(99, True).fit(wide).getIndices() == [0, 1]
    assert encoders.FeatureSelector("all", True).fit(wide).getIndices() == [0, 1]


def test_pipeline_round_trip(txn, tmp_path):
    train, test = txn.where("txn_id % 5 <> 0"), txn.where("txn_id % 5 = 0")
    model = encoders.build_preprocessing(PREPROCESSING, "is_fraud", ["txn_id", "ingest_ts"]).fit(train)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    out = lambda m: {r["txn_id"]: r["features"] for r in m.transform(test).select("txn_id", "features").collect()}
    first = out(model)
    assert first == out(again) and len(first) == test.count()
    widths = {v.size for v in first.values()}
    assert widths == {40}


def test_polynomial_stage(txn):
    settings = {**SETTINGS, "use_feature_engineering": False, "use_polynomial_features": True, "polynomial_degree": 2, "scaler": None}
    small = txn.select("txn_id", "is_fraud", "txn_dt", "card1")
    model = encoders.build_preprocessing(settings, "is_fraud", ["txn_id"]).fit(small)
    assert model.transform(small).first()["features"].size == 5


def test_encodings_are_joined_once_per_key(txn):
    model = encoders.FeatureEngineer(SETTINGS, "is_fraud", ["txn_id", "ingest_ts"]).fit(txn)
    plan = model.transform(txn)._jdf.queryExecution().optimizedPlan().toString()
    keys = model.get_fitted()["keys"]
    assert plan.count("Join LeftOuter") == len(keys) and "card4" in keys and keys["card4"]["uses"] == ["target_mean", "median"]
    assert plan.count("strategy=broadcast") == len(keys)


def test_number_text(spark):
    df = spark.createDataFrame([(150.0,), (12345678.0,), (12345678.5,), (0.0001,), (0.25,), (None,), (float("nan"),)], "x double")
    found = [r[0] for r in df.select(expr.category(df, "x")).collect()]
    assert found == ["150.0", "12345678.0", "12345678.5", "0.0001", "0.25", "__missing__", "__missing__"]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("x",), (None,), ("nan",)], "s string")
    assert [r[0] for r in df.select(expr.to_number(df, "s")).collect()] == [1.5, None, None, None]


def test_payloads(spark):
    df = spark.createDataFrame([({" a ": "1"},), ({" ": "1"},), ({"a": "inf"},), ({},), (None,), ({"a": "1", "a ": "2"},)], "m map<string,string>")
    checked = expr.check_payload(F.col("m"))
    rows = [(r["f"], r["r"]) for r in df.select(checked["features"].alias("f"), checked["reject_reason"].alias("r")).collect()]
    assert rows == [({"a": "1"}, None), (None, "blank_name"), (None, "not_finite"), (None, "empty"), (None, "empty"), ({"a": "2"}, None)]


def test_broadcasts_share_a_budget(monkeypatch, txn):
    from millrace.operators import joins

    assert joins.within_budget({"a": [10, 5], "b": [joins.BROADCAST_ROWS, 5], "c": [20, joins.BROADCAST_TEXT]}) == {"a"}
    model = encoders.FeatureEngineer(SETTINGS, "is_fraud", ["txn_id", "ingest_ts"]).fit(txn)
    kept = ["txn_id", "card1_frequency", "card4_target_mean"]
    first = sorted(map(tuple, model.transform(txn).select(kept).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    plain = model.transform(txn)
    assert "strategy=broadcast" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plain.select(kept).collect())) == first


def test_fit_reads_engineered_rows_once(spark, txn, tmp_path):
    from pyspark.ml import PipelineModel

    from millrace.operators.encoders import PassThrough, build_preprocessing
    from millrace.session import WRITTEN, clear_scratch

    settings = {"use_feature_engineering": True, "amount_column": "txn_amt", "log_transform_features": ["txn_amt"], "scaler": "standard"}
    rows = txn.select("txn_id", "is_fraud", "txn_amt", "card4")
    fitted = build_preprocessing(settings, "is_fraud", ["txn_id"]).fit(rows)
    kept = next(s for s in fitted.stages if isinstance(s, PassThrough))
    assert kept._seen is None and kept._written is None and WRITTEN
    fitted.write().overwrite().save(str(tmp_path / "model"))
    first = [r["features"] for r in fitted.transform(rows).orderBy("txn_id").limit(5).collect()]
    again = [r["features"] for r in PipelineModel.load(str(tmp_path / "model")).transform(rows).orderBy("txn_id").limit(5).collect()]
    assert first == again
    held = list(WRITTEN)
    clear_scratch(spark)
    assert held and not WRITTEN


CROSSED = {"use_feature_engineering": True, "use_target_mean_encoding": True, "target_mean_smoothing": 2.0, "target_mean_encode_features": ["k"], "target_mean_folds": 3,
           "use_frequency_encoding": True, "frequency_encode_features": ["k"]}


def test_target_means_of_other_folds(spark, tmp_path):
    """Rows learned from: the smoothed mean of their value in the other folds, or those folds' mean; other rows: that of all."""
    rng = np.random.default_rng(8)
    data = [(i, int(rng.integers(0, 2)), str(rng.integers(0, 25)) if i % 9 else None) for i in range(200)] + [(900, None, "3"), (901, 1, "alone")]
    df = spark.createDataFrame(data, "id int, y int, k string")
    model = encoders.FeatureEngineer(CROSSED, "y", ["id"]).fit(df)
    fold = {r["id"]: r["f"] for r in df.select("id", encoders.fold_of(df, CROSSED, ["id"], "y").alias("f")).collect()}
    assert set(fold.values()) == {0, 1, 2}

    def want(i, k, others):
        known = [(kk or "__missing__", y) for j, y, kk in data if y is not None and (not others or fold[j] != fold[i])]
        prior, own = np.mean([y for _, y in known]), [y for kk, y in known if kk == (k or "__missing__")]
        return (sum(own) + 2 * prior) / (len(own) + 2) if own else prior

    crossed = {r["id"]: r for r in model.transform(df).collect()}  # the very frame it was fitted on
    again = {r["id"]: r for r in model.for_training(df.select("*")).collect()}
    plain = {r["id"]: r for r in model.transform(df).collect()}  # a second time these are rows like others
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = {r["id"]: r for r in encoders.FeatureEngineerModel.load(str(tmp_path / "m")).transform(df).collect()}
    for i, _, k in data:
        assert crossed[i] == again[i] and plain[i] == loaded[i] and crossed[i]["k_frequency"] == plain[i]["k_frequency"]
        assert crossed[i]["k_target_mean"] == pytest.approx(want(i, k, True)) and plain[i]["k_target_mean"] == pytest.approx(want(i, k, False))


def test_crossed_means_do_not_leak(spark):
    """A target of chance over keys of two rows: in-sample means rank the training rows well, those of the other folds do not."""
    from millrace.operators.evaluation import areas

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(rng.integers(0, 2)), f"k{i // 2}") for i in range(4000)], "id int, y int, k string")
    area = {}
    for folds in (0, 5):
        model = encoders.FeatureEngineer({**CROSSED, "target_mean_folds": folds}, "y", ["id"]).fit(df)
        area[folds] = areas(model.for_training(df), "y", "k_target_mean").first()["roc_auc"]
    assert area[0] > 0.8 and area[5] < 0.55


def test_in_sample_without_folds(three):
    model = encoders.FeatureEngineer(CONFIG, "isFraud").fit(three)
    assert model._seen is None and model.get_fitted()["left_out"] == [] and encoders.fold_of(three, CONFIG, [], "isFraud") is None
    assert sorted(model.transform(three).collect(), key=repr) == sorted(model.for_training(three).collect(), key=repr)
