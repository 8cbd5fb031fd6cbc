"""Queries over the contract, quality checks, drift and monitoring."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import contract, drift, quality
from ..operators.profile import category_tables, numeric_profile
from ..session import materialize
from ..sources.fixtures import scores, transactions
from .catalog import query, rounded
from .catalog_tables import _profile_sql, shown_profile, slices
from .monitoring import performance_by_slice, quality_comparison, run_monitoring
from .validation import build_profile, validate

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
CONFIG = {
    "validation": {"dataset_name": "txn", "target_column": "is_fraud", "id_column": "txn_id"},
    "schema": {
        "required_columns": [
            {"name": "txn_id", "dtype": "int", "nullable": False},
            {"name": "is_fraud", "dtype": "int", "nullable": False},
            {"name": "txn_dt", "dtype": "float", "nullable": False},
            {"name": "txn_amt", "dtype": "float", "nullable": False},
            {"name": "addr1", "dtype": "int", "nullable": True},
            {"name": "ingest_ts", "dtype": "float", "nullable": True},
            {"name": "card4", "dtype": "string", "nullable": True},
        ],
        "numeric_ranges": {"txn_amt": {"min": 5000, "max": 450000.0}, "txn_dt": {"min": 0, "max": 300000000}, "addr1": {"max": 20}},
        "categorical_allowed_values": {"card4": SEGMENTS, "product_cd": ["1", "2", "3", "4"], "card6": ["credit", "debit"]},
        "null_thresholds": {"txn_id": 0.0, "txn_amt": 0.05, "card4": 0.20, "p_email": 0.10, "r_email": 0.30},
    },
    "quality": {
        "duplicates": {"subset": ["card1", "product_cd", "card4"], "max_fraction": 0.1},
        "unexpected_categories": {"fail": True},
        "outliers": {"columns": ["txn_amt", "is_fraud", "card1"], "robust_zscore_threshold": 1.2, "max_fraction": 0.05},
        "class_imbalance": {"target_column": "is_fraud", "min_minority_ratio": 0.05},
        "freshness": {"timestamp_column": "ingest_ts", "reference_time": "2001-06-01T00:00:00Z", "max_age_days": 10, "max_future_days": 1},
    },
    "drift": {
        "numeric_columns": ["txn_amt", "txn_dt", "card1"],
        "categorical_columns": ["product_cd", "card4", "p_email"],
        "ks_statistic_threshold": 0.25,
    },
}
SCHEMA = CONFIG["schema"]
_SEGMENTS_SQL = ", ".join(f"'{s}'" for s in SEGMENTS)


# -- contract ---------------------------------------------------------------------------


def _rule_sql(column, check, predicate):
    return f"SELECT '{column}' AS \"column\", '{check}' AS \"check\", count(*) FILTER (WHERE {predicate}) AS n FROM txn"


_TYPE_RULES = [
    ("txn_id", "dtype", "FALSE"), ("txn_id", "not_nullable", "txn_id IS NULL"), ("is_fraud", "dtype", "FALSE"),
    ("is_fraud", "not_nullable", "is_fraud IS NULL"), ("txn_dt", "dtype", "FALSE"), ("txn_dt", "not_nullable", "txn_dt IS NULL"),
    ("txn_amt", "dtype", "FALSE"), ("txn_amt", "not_nullable", "txn_amt IS NULL"),
    ("addr1", "dtype", "addr1 IS NOT NULL AND floor(addr1) <> addr1"),
    ("ingest_ts", "dtype", "ingest_ts IS NOT NULL AND TRY_CAST(ingest_ts AS DOUBLE) IS NULL"), ("card4", "dtype", "FALSE"),
]
_RANGE_RULES = [
    ("txn_dt", "min", "txn_dt < 0"), ("txn_dt", "max", "txn_dt > 300000000"), ("txn_amt", "min", "txn_amt < 5000"),
    ("txn_amt", "max", "txn_amt > 450000"), ("addr1", "max", "addr1 > 20"),
]
_ALLOWED_RULES = [("card4", "allowed", f"card4 NOT IN ({_SEGMENTS_SQL})")]


@query("schema_contract_violations", " UNION ALL ".join(_rule_sql(*r) for r in _TYPE_RULES), "txn")
def schema_contract_violations(spark, sf_dir):
    return contract.violation_counts(transactions(spark, sf_dir), SCHEMA, ("dtype", "not_nullable"))


@query("range_violations", " UNION ALL ".join(_rule_sql(*r) for r in _RANGE_RULES), "txn")
def range_violations(spark, sf_dir):
    return contract.violation_counts(transactions(spark, sf_dir), SCHEMA, ("min", "max"))


@query("allowed_value_violations", " UNION ALL ".join(_rule_sql(*r) for r in _ALLOWED_RULES), "txn")
def allowed_value_violations(spark, sf_dir):
    return contract.violation_counts(transactions(spark, sf_dir), SCHEMA, ("allowed",))


@query(
    "schema_failure_cases",
    f"""SELECT 'txn_amt' AS "column", 'not_nullable' AS "check", txn_id AS row_key, CAST(NULL AS VARCHAR) AS value FROM txn WHERE txn_amt IS NULL
        UNION ALL SELECT 'txn_amt', 'min', txn_id, CAST(txn_amt AS VARCHAR) FROM txn WHERE txn_amt < 5000
        UNION ALL SELECT 'txn_amt', 'max', txn_id, CAST(txn_amt AS VARCHAR) FROM txn WHERE txn_amt > 450000
        UNION ALL SELECT 'txn_dt', 'max', txn_id, CAST(txn_dt AS VARCHAR) FROM txn WHERE txn_dt > 300000000
        UNION ALL SELECT 'addr1', 'max', txn_id, CAST(addr1 AS VARCHAR) FROM txn WHERE addr1 > 20
        UNION ALL SELECT 'ingest_ts', 'dtype', txn_id, ingest_ts FROM txn WHERE ingest_ts IS NOT NULL AND TRY_CAST(ingest_ts AS DOUBLE) IS NULL
        UNION ALL SELECT 'card4', 'allowed', txn_id, card4 FROM txn WHERE card4 NOT IN ({_SEGMENTS_SQL})""",
    "txn",
)
def schema_failure_cases(spark, sf_dir):
    return contract.failure_cases(transactions(spark, sf_dir), SCHEMA, "txn_id").select("column", "check", "row_key", "value")


@query(
    "schema_failure_report",
    """SELECT 'txn_dt' AS "column", 'max' AS "check", txn_id AS row_key, CAST(txn_dt AS VARCHAR) AS value FROM txn WHERE txn_dt > 300000000
       ORDER BY txn_id LIMIT 30""",
    "txn",
)
def schema_failure_report(spark, sf_dir):
    return contract.listed_failures(transactions(spark, sf_dir), SCHEMA, "txn_id").select("column", "check", "row_key", "value")


# -- quality ------------------------------------------------------------------------------

_NULL_LIMITS = SCHEMA["null_thresholds"]


@query(
    "null_thresholds",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round(1 - count({c}) / count(*), 6) AS missing_fraction, "
        f"1 - count({c}) / count(*) > {limit} AS exceeded FROM txn"
        for c, limit in _NULL_LIMITS.items()
    ),
    "txn",
)
def null_thresholds(spark, sf_dir):
    limit = F.create_map(*[F.lit(x) for pair in _NULL_LIMITS.items() for x in pair])
    found = quality.null_fractions(transactions(spark, sf_dir), list(_NULL_LIMITS))
    return found.select(
        "column", "missing_count", rounded("missing_fraction"), (F.col("missing_fraction") > limit[F.col("column")]).alias("exceeded")
    )


@query(
    "duplicate_fraction",
    """, c AS (SELECT count(*) AS n FROM txn GROUP BY card1, product_cd, card4)
       SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicates,
       round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n), 6) AS fraction FROM c""",
    "txn",
)
def duplicate_fraction(spark, sf_dir):
    found = quality.duplicate_summary(transactions(spark, sf_dir), ["card1", "product_cd", "card4"])
    return found.select("rows", "duplicates", F.round(F.col("duplicates").cast("double") / F.col("rows"), 6).alias("fraction"))


@query(
    "unexpected_categories",
    f"""SELECT DISTINCT 'card4' AS "column", card4 AS value FROM txn WHERE card4 NOT IN ({_SEGMENTS_SQL})
        UNION ALL SELECT DISTINCT 'product_cd', product_cd FROM txn WHERE product_cd NOT IN ('1', '2', '3', '4')
        UNION ALL SELECT DISTINCT 'card6', card6 FROM txn WHERE card6 NOT IN ('credit', 'debit')""",
    "txn",
)
def unexpected_categories(spark, sf_dir):
    return quality.unexpected_values(transactions(spark, sf_dir), SCHEMA["categorical_allowed_values"])


def _outlier_sql(c, threshold):
    return f"""SELECT '{c}' AS "column", count(*) AS n, round(any_value(m), 4) AS median, round(any_value(d), 4) AS mad,
      count(*) FILTER (WHERE abs(CASE WHEN d > 0 THEN 0.6745 * (x - m) / d WHEN s > 0 THEN (x - a) / s ELSE 0 END) > {threshold}) AS outlier_count FROM
      (SELECT CAST({c} AS DOUBLE) AS x FROM txn WHERE {c} IS NOT NULL) v,
      (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m, avg({c}) AS a, stddev_pop({c}) AS s FROM txn) b,
      (SELECT quantile_cont(abs({c} - (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM txn)), 0.5) AS d FROM txn) e"""


@query("robust_outliers", " UNION ALL ".join(_outlier_sql(c, 1.2) for c in ("txn_amt", "is_fraud", "card1")), "txn")
def robust_outliers(spark, sf_dir):
    seen = quality.outlier_counts(transactions(spark, sf_dir), ["txn_amt", "is_fraud", "card1"], 1.2)
    rows = [(c, s["n"], round(s["median"], 4), round(s["mad"], 4), s["outlier_count"]) for c, s in seen.items()]
    return spark.createDataFrame(rows, "column string, n bigint, median double, mad double, outlier_count bigint")


@query(
    "class_balance",
    "SELECT CAST(is_fraud AS VARCHAR) AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM txn GROUP BY is_fraud",
    "txn",
)
def class_balance(spark, sf_dir):
    return quality.class_counts(transactions(spark, sf_dir), "is_fraud").withColumn("share", rounded("share"))


@query(
    "freshness",
    """, p AS (SELECT ingest_ts AS raw, TRY_CAST(ingest_ts AS TIMESTAMP) AS ts FROM txn)
       SELECT count(raw) AS non_null, count(ts) AS valid, count(*) FILTER (WHERE ts > TIMESTAMP '2001-06-02') AS future,
       CAST(epoch_us(max(ts)) AS BIGINT) AS latest_us FROM p""",
    "txn",
)
def freshness(spark, sf_dir):
    at = quality.reference_moment("2001-06-01T00:00:00Z")
    return quality.freshness_counts(transactions(spark, sf_dir), "ingest_ts", at, 1.0)


_SUITE_SQL = f"""
, facts AS (SELECT count(*) AS n, avg(is_fraud) AS rate, 1 - count(txn_amt) / count(*) AS m_amt, 1 - count(card4) / count(*) AS m_card4,
    1 - count(p_email) / count(*) AS m_p, 1 - count(r_email) / count(*) AS m_r, bool_or(card4 NOT IN ({_SEGMENTS_SQL})) AS u_card4,
    bool_or(product_cd NOT IN ('1', '2', '3', '4')) AS u_product, count(*) FILTER (WHERE TRY_CAST(ingest_ts AS TIMESTAMP) IS NULL) AS bad_ts,
    count(*) FILTER (WHERE TRY_CAST(ingest_ts AS TIMESTAMP) > TIMESTAMP '2001-06-02') AS future_ts, max(TRY_CAST(ingest_ts AS TIMESTAMP)) AS latest FROM txn),
dup AS (SELECT sum(c) FILTER (WHERE c > 1) / sum(c) AS f FROM (SELECT count(*) AS c FROM txn GROUP BY card1, product_cd, card4)),
o AS ({" UNION ALL ".join(_outlier_sql(c, 1.2) for c in ("txn_amt", "is_fraud", "card1"))}),
issues AS (
SELECT 'missing_value_threshold' AS "check", 'error' AS severity, 'txn_amt' AS "column" FROM facts WHERE m_amt > 0.05
UNION ALL SELECT 'missing_value_threshold', 'error', 'card4' FROM facts WHERE m_card4 > 0.20
UNION ALL SELECT 'missing_value_threshold', 'error', 'p_email' FROM facts WHERE m_p > 0.10
UNION ALL SELECT 'missing_value_threshold', 'error', 'r_email' FROM facts WHERE m_r > 0.30
UNION ALL SELECT 'duplicate_rows', 'error', NULL FROM dup WHERE f > 0.1
UNION ALL SELECT 'unexpected_category', 'error', 'card4' FROM facts WHERE u_card4
UNION ALL SELECT 'unexpected_category', 'error', 'product_cd' FROM facts WHERE u_product
UNION ALL SELECT 'outlier_fraction', 'warning', "column" FROM o WHERE outlier_count / n > 0.05
UNION ALL SELECT 'class_imbalance', 'warning', 'is_fraud' FROM facts WHERE least(rate, 1 - rate) < 0.05
UNION ALL SELECT 'invalid_timestamp', 'error', 'ingest_ts' FROM facts WHERE bad_ts > 0
UNION ALL SELECT 'future_timestamp', 'error', 'ingest_ts' FROM facts WHERE future_ts > 0
UNION ALL SELECT 'data_freshness', 'error', 'ingest_ts' FROM facts WHERE latest < TIMESTAMP '2001-05-22')
"""


@query("quality_suite", _SUITE_SQL + 'SELECT "check", severity, "column" FROM issues', "txn")
def quality_suite(spark, sf_dir):
    found, _ = quality.build_suite(CONFIG).run(transactions(spark, sf_dir))
    return quality.issues_frame(spark, found).select("check", "severity", "column")


@query(
    "gate_decision",
    _SUITE_SQL + """SELECT count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count,
    count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM issues""",
    "txn",
)
def gate_decision(spark, sf_dir):
    found, _ = quality.build_suite(CONFIG).run(transactions(spark, sf_dir))
    return quality.gate(quality.issues_frame(spark, found))


# -- drift ----------------------------------------------------------------------------------

_REF, _CUR = "txn_dt < 240000000", "txn_dt >= 240000000"


def _numeric_profile_rows(where, name=None):
    extra = f", '{name}' AS slice" if name else ""
    return " UNION ALL ".join(_profile_sql(c, where, extra) for c in ("txn_amt", "txn_dt", "card1"))


def _shares_sql(c, where):
    """Top-100 shares of a column, as a derived table."""
    return f"""(SELECT coalesce({c}, '__missing__') AS value, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM txn WHERE {where} GROUP BY 1
      QUALIFY row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, '__missing__')) <= 100)"""


@query("baseline_profile", _numeric_profile_rows(_REF), "txn")
def baseline_profile(spark, sf_dir):
    return shown_profile(build_profile(slices(spark, sf_dir)[0], CONFIG)["numeric"])


@query(
    "baseline_distribution",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", value, share FROM {_shares_sql(c, _REF)}" for c in ("product_cd", "card4", "p_email"))
    + " UNION ALL SELECT 'is_fraud', CAST(is_fraud AS VARCHAR), round(count(*) / sum(count(*)) OVER (), 8) FROM txn WHERE txn_dt < 240000000 GROUP BY is_fraud",
    "txn",
)
def baseline_distribution(spark, sf_dir):
    _, shares = category_tables(slices(spark, sf_dir)[0], ["product_cd", "card4", "p_email", "is_fraud"])
    return shares


@query(
    "schema_drift",
    """SELECT 'missing' AS change, 'card6' AS name, count(card6) AS filled FROM txn
       UNION ALL SELECT 'missing', 'r_email', count(r_email) FROM txn
       UNION ALL SELECT 'new', 'channel', count(*) FROM txn""",
    "txn",
)
def schema_drift(spark, sf_dir):
    """Columns that came or went between a table's stored profile and a written table, with the rows that have a value there."""
    before = transactions(spark, sf_dir)
    stored = materialize(filled_rows(before))
    now = materialize(before.drop("card6", "r_email").withColumn("channel", F.lit(1)))
    names = [r["name"] for r in stored.select("name").collect()]
    diff = drift.schema_drift(now.columns, names, names)
    changes = spark.createDataFrame([(k, n) for k, found in diff.items() for n in found], "change string, name string")
    held = stored.unionByName(filled_rows(now.select(*[c for c in now.columns if c not in names])))
    return changes.join(F.broadcast(held), "name").select("change", "name", "filled")


def filled_rows(df: DataFrame) -> DataFrame:
    """``name, filled``: how many rows have a value, for every column, from one aggregation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.count(F.col(c)).alias("filled")) for c in df.columns])
    return df.agg(pairs.alias("p")).select(F.inline("p"))


def _ks_sql(c):
    return f"""SELECT '{c}' AS "column", round(max(abs(f - g)), 8) AS ks, any_value(na) AS ref_rows, any_value(nb) AS cur_rows FROM
      (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS g,
       CAST(sum(a) OVER () AS BIGINT) AS na, CAST(sum(b) OVER () AS BIGINT) AS nb FROM
       (SELECT {c} AS x, count(*) FILTER (WHERE {_REF}) AS a, count(*) FILTER (WHERE {_CUR}) AS b FROM txn WHERE {c} IS NOT NULL GROUP BY 1))"""


@query("ks_two_sample", " UNION ALL ".join(_ks_sql(c) for c in ("txn_amt", "txn_dt", "card1")), "txn")
def ks_two_sample(spark, sf_dir):
    found = drift.two_sample(*slices(spark, sf_dir), ["txn_amt", "txn_dt", "card1"])
    return found.select("column", rounded("ks", 8), "ref_rows", "cur_rows")


def _js_sql(c, shift=None):
    right = _shares_sql(c, _CUR) if shift is None else shift
    return f"""SELECT '{c}' AS "column", round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS js FROM
      (SELECT coalesce(a.share, 0) / sum(coalesce(a.share, 0)) OVER () AS p, coalesce(b.share, 0) / sum(coalesce(b.share, 0)) OVER () AS q
       FROM {_shares_sql(c, _REF)} a FULL JOIN {right} b ON a.value = b.value)"""


_JS_COLUMNS = ("product_cd", "card4", "p_email", "ingest_ts")


@query("js_distance", " UNION ALL ".join(_js_sql(c) for c in _JS_COLUMNS), "txn")
def js_distance(spark, sf_dir):
    before, now = [drift.distributions(d, list(_JS_COLUMNS)) for d in slices(spark, sf_dir)]
    return drift.js_distances(before, now).withColumn("js", rounded("js"))


def _shift_sql(c):
    return f"""SELECT '{c}' AS "column", round(abs(b.m - a.m) / CASE WHEN a.s > 0 THEN a.s ELSE 1 END, 6) AS mean_shift_std FROM
      (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM txn WHERE {_REF}) a, (SELECT avg({c}) AS m FROM txn WHERE {_CUR}) b"""


@query("mean_shift_baseline", " UNION ALL ".join(_shift_sql(c) for c in ("txn_amt", "txn_dt", "card1")), "txn")
def mean_shift_baseline(spark, sf_dir):
    reference, current = slices(spark, sf_dir)
    names = ["txn_amt", "txn_dt", "card1"]
    found = drift.mean_shifts(numeric_profile(reference, names), numeric_profile(current, names))
    return found.select("column", rounded("mean_shift_std"))


@query("js_baseline", " UNION ALL ".join(_js_sql(c) for c in ("product_cd", "card4", "p_email")), "txn")
def js_baseline(spark, sf_dir):
    """Against the shares of a stored profile."""
    reference, current = slices(spark, sf_dir)
    stored = build_profile(reference, CONFIG)["distribution"].where("role = 'feature'")
    now = drift.distributions(current, ["product_cd", "card4", "p_email"])
    return drift.js_distances(stored, now).withColumn("js", rounded("js"))


@query(
    "inject_numeric_drift",
    f""", s AS (SELECT stddev_pop(addr1) AS d, quantile_cont(addr1, 0.5) AS m FROM txn WHERE {_CUR})
        SELECT txn_id, round(txn_amt * 4.0, 4) AS txn_amt, txn_dt + 1209600 AS txn_dt, card1 + 5000 AS card1,
        round(addr1 + 2.0 * d + abs(m * 0.10), 6) AS addr1 FROM txn, s WHERE {_CUR}""",
    "txn",
)
def inject_numeric_drift(spark, sf_dir):
    _, current = slices(spark, sf_dir)
    moved = drift.inject_numeric(current, ["txn_amt", "txn_dt", "card1", "addr1"], {"txn_amt": 4.0}, {"txn_dt": 1209600.0, "card1": 5000.0})
    return moved.select("txn_id", rounded("txn_amt", 4), "txn_dt", "card1", rounded("addr1"))


@query(
    "inject_categorical_drift",
    f"""SELECT 'product_cd' AS "column", count(*) AS n, TRUE AS only_token, TRUE AS share_near FROM txn WHERE {_CUR}
        UNION ALL SELECT 'p_email', count(*), TRUE, TRUE FROM txn WHERE {_CUR}""",
    "txn",
)
def inject_categorical_drift(spark, sf_dir):
    """Rows kept, changed values all the token, and about three quarters of the rows hit."""
    _, current = slices(spark, sf_dir)
    tokens = {"product_cd": "drifted", "p_email": "drifted.example.com"}
    moved = drift.inject_categorical(current, list(tokens), "txn_id", 0.75, tokens, 42)
    both = moved.select("txn_id", *[F.col(c).alias(f"new_{c}") for c in tokens]).join(current, "txn_id")
    parts = []
    for c, token in tokens.items():
        hit = F.col(f"new_{c}").eqNullSafe(F.lit(token))
        share = F.avg(hit.cast("double"))
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"),
                F.every(hit | F.col(f"new_{c}").eqNullSafe(F.col(c))).alias("only_token"),
                share.between(0.65, 0.85).alias("share_near"),
            )
        )
    return both.agg(F.array(*parts).alias("t")).select(F.explode("t").alias("t")).select("t.*")


def _w1_sql(c):
    return f"""SELECT '{c}' AS "column", round(sum(abs(f - g) * coalesce(nx - x, 0)) / greatest((SELECT stddev_pop({c}) FROM txn WHERE {_REF}), 0.001), 6) AS score FROM
      (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS g FROM
       (SELECT {c} AS x, count(*) FILTER (WHERE {_REF}) AS a, count(*) FILTER (WHERE {_CUR}) AS b FROM txn WHERE {c} IS NOT NULL GROUP BY 1))"""


@query("wasserstein_normalized", " UNION ALL ".join(_w1_sql(c) for c in ("txn_amt", "txn_dt", "card1")), "txn")
def wasserstein_normalized(spark, sf_dir):
    found = drift.drift_scores(*slices(spark, sf_dir), ["txn_amt", "txn_dt", "card1"], [])
    return found.select(F.col("feature").alias("column"), rounded("score"))


def _plain_js_sql(c):
    share = lambda where: f"(SELECT {c} AS value, count(*) / sum(count(*)) OVER () AS share FROM txn WHERE {where} AND {c} IS NOT NULL GROUP BY 1)"
    return f"""SELECT '{c}' AS "column", sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS score FROM
      (SELECT coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM {share(_REF)} a FULL JOIN {share(_CUR)} b ON a.value = b.value)"""


_SCORES_SQL = ", s AS (" + " UNION ALL ".join([_w1_sql("txn_amt"), _w1_sql("txn_dt"), _plain_js_sql("card4"), _plain_js_sql("ingest_ts")]) + ")"


def _scores_table(spark, sf_dir):
    return drift.drift_scores(*slices(spark, sf_dir), ["txn_amt", "txn_dt"], ["card4", "ingest_ts"])


@query(
    "drift_summary",
    _SCORES_SQL + """ SELECT count(*) AS number_of_columns, count(*) FILTER (WHERE score >= 0.1) AS number_of_drifted_columns,
    round(count(*) FILTER (WHERE score >= 0.1) / count(*), 6) AS share_of_drifted_columns, count(*) FILTER (WHERE score >= 0.1) / count(*) >= 0.5 AS dataset_drift,
    string_agg("column", ',' ORDER BY "column") FILTER (WHERE score >= 0.1) AS drifted FROM s""",
    "txn",
)
def drift_summary(spark, sf_dir):
    found = drift.drift_summary(_scores_table(spark, sf_dir))
    return found.select(
        "number_of_columns", "number_of_drifted_columns", rounded("share_of_drifted_columns"), "dataset_drift",
        F.concat_ws(",", "drifted_features.feature").alias("drifted"),
    )


@query(
    "drift_status",
    _SCORES_SQL + """ SELECT CASE WHEN count(*) FILTER (WHERE score >= 0.1) / count(*) > 0.2 THEN 'data_drift_detected' ELSE 'data_drift_within_threshold' END AS event,
    'drift' AS report, CAST(0.2 AS DOUBLE) AS threshold, count(*) AS number_of_columns, count(*) FILTER (WHERE score >= 0.1) AS number_of_drifted_columns,
    round(count(*) FILTER (WHERE score >= 0.1) / count(*), 6) AS share_of_drifted_columns FROM s""",
    "txn",
)
def drift_status(spark, sf_dir):
    found = drift.drift_status(drift.drift_summary(_scores_table(spark, sf_dir)), "drift", 0.2)
    return found.withColumn("share_of_drifted_columns", rounded("share_of_drifted_columns"))


# The suite's issues over the later slice only; the drift rules look at both slices.
_LATE_ISSUES = f"(WITH txn AS (SELECT * FROM late) {_SUITE_SQL} SELECT \"check\", severity, \"column\" FROM issues)"
_LATE_RULES = " UNION ALL ".join(_rule_sql(*r) for r in _TYPE_RULES + _RANGE_RULES + _ALLOWED_RULES)
_VALIDATION_SQL = f"""
, late AS (SELECT * FROM txn WHERE {_CUR}),
broken AS (SELECT 0 AS rule, txn_id, 'txn_dt' AS "column", 'max' AS kind, CAST(txn_dt AS VARCHAR) AS value FROM late WHERE txn_dt > 300000000
    UNION ALL SELECT 1, txn_id, 'txn_amt', 'not_nullable', 'None' FROM late WHERE txn_amt IS NULL
    UNION ALL SELECT 2, txn_id, 'txn_amt', 'min', CAST(txn_amt AS VARCHAR) FROM late WHERE txn_amt < 5000),
listed AS (SELECT 'schema_contract' AS "check", 'error' AS severity, "column",
    concat('Column ', chr(39), "column", chr(39), ' breaks the rule ', chr(39), kind, chr(39), ' at ', chr(39), txn_id, chr(39), ' with ', chr(39), value, chr(39), '.') AS failure
    FROM broken ORDER BY rule, txn_id LIMIT 30)
SELECT * FROM listed
UNION ALL SELECT 'schema_contract', 'error', NULL, CAST(sum(n) - 30 AS BIGINT) || ' further failing values.' FROM (WITH txn AS (SELECT * FROM late) {_LATE_RULES}) c
UNION ALL SELECT "check", severity, "column", NULL FROM {_LATE_ISSUES} i
UNION ALL SELECT 'numeric_distribution_drift', 'warning', "column", NULL FROM ({" UNION ALL ".join(_ks_sql(c) for c in ("txn_amt", "txn_dt", "card1"))}) k WHERE ks > 0.25
UNION ALL SELECT 'categorical_distribution_drift', 'warning', "column", NULL FROM ({" UNION ALL ".join(_js_sql(c) for c in ("product_cd", "card4", "p_email"))}) j WHERE js > 0.2
"""


@query("validation_run", _VALIDATION_SQL, "txn")
def validation_run(spark, sf_dir):
    """The issues of the whole gate; the texts are shown for failing values, which they name."""
    reference, current = slices(spark, sf_dir)
    issues = validate(current, CONFIG, reference).issues_table(spark)
    return issues.select("check", "severity", "column", F.when(F.col("check") == "schema_contract", F.col("message")).alias("failure"))


@query("quality_comparison", _numeric_profile_rows(_REF, "reference") + " UNION ALL " + _numeric_profile_rows(_CUR, "current"), "txn")
def compare_quality(spark, sf_dir):
    reference, current = slices(spark, sf_dir)
    return shown_profile(quality_comparison({"reference": reference, "current": current}, ["txn_amt", "txn_dt", "card1"]))


@query(
    "performance_by_slice",
    """, c AS (SELECT CASE WHEN txn_dt < 240000000 THEN 'reference' ELSE 'current' END AS slice, count(*) FILTER (WHERE is_fraud = 1 AND score >= 0.9) AS tp,
       count(*) FILTER (WHERE is_fraud = 0 AND score >= 0.9) AS fp, count(*) FILTER (WHERE is_fraud = 1 AND score < 0.9) AS fn,
       count(*) FILTER (WHERE is_fraud = 0 AND score < 0.9) AS tn FROM scored GROUP BY 1)
       SELECT slice, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1,
       round(coalesce(5 * tp / nullif(5 * tp + fp + 4 * fn, 0), 0), 8) AS f2 FROM c""",
    "scored",
)
def slice_performance(spark, sf_dir):
    scored = scores(spark, sf_dir).withColumn("prediction", (F.col("score") >= 0.9).cast("int"))
    parts = {"reference": scored.where("txn_dt < 240000000"), "current": scored.where("txn_dt >= 240000000")}
    found = performance_by_slice(parts, "is_fraud")
    return found.select("slice", *[rounded(m, 8) for m in ("accuracy", "precision", "recall", "f1", "f2")])


MONITORING = {
    "sample_size": None,  # all rows
    "drifted_numeric_columns": ["txn_amt", "txn_dt", "card1"],
    "drifted_categorical_columns": ["product_cd", "p_email", "card4"],
    "numeric_multiply": {"txn_amt": 4.0},
    "numeric_shift": {"txn_dt": 1209600.0, "card1": 5000.0},
    "categorical_replacements": {"product_cd": "1", "p_email": "drifted.example.com", "card4": "BUILDING"},
}


def _two_table_scores(report, now):
    """Scores of the table ``now`` against ``early``, under the name of a report."""
    numeric = [
        f"""SELECT '{report}' AS report, '{c}' AS "column", sum(abs(f - g) * coalesce(nx - x, 0)) / greatest((SELECT stddev_pop({c}) FROM early), 0.001) AS score FROM
        (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(p) OVER (ORDER BY x) / sum(p) OVER () AS f, sum(q) OVER (ORDER BY x) / sum(q) OVER () AS g FROM
        (SELECT x, sum(p) AS p, sum(q) AS q FROM (SELECT {c} AS x, 1 AS p, 0 AS q FROM early UNION ALL SELECT {c}, 0, 1 FROM {now}) u WHERE x IS NOT NULL GROUP BY x))"""
        for c in ("txn_amt", "txn_dt", "card1")
    ]
    share = lambda c, t: f"(SELECT {c} AS value, count(*) / sum(count(*)) OVER () AS share FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"
    texts = [
        f"""SELECT '{report}', '{c}', sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0))
        FROM (SELECT coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM {share(c, "early")} a FULL JOIN {share(c, now)} b ON a.value = b.value)"""
        for c in ("product_cd", "card4", "card6", "p_email", "is_fraud")
    ]
    return " UNION ALL ".join(numeric + texts)


def _drawn(text):
    """A number below 2**32 from the md5 of a text, alike in both engines."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# Both engines cut the halves, and pick the rows that drift, by the md5 of the id.
_MONITORING_SQL = f"""
, early AS (SELECT * FROM txn WHERE CAST('0x' || substr(md5(CAST(txn_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0),
clean AS (SELECT * FROM txn WHERE CAST('0x' || substr(md5(CAST(txn_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 1),
moved AS (SELECT txn_amt * 4 AS txn_amt, txn_dt + 1209600 AS txn_dt, card1 + 5000 AS card1, card6, is_fraud,
    CASE WHEN hit THEN '1' ELSE product_cd END AS product_cd, CASE WHEN hit THEN 'drifted.example.com' ELSE p_email END AS p_email,
    CASE WHEN hit THEN 'BUILDING' ELSE card4 END AS card4 FROM (SELECT *, CAST('0x' || substr(md5(txn_id || ':drift'), 1, 8) AS BIGINT) % 4 < 3 AS hit FROM clean)),
s AS ({_two_table_scores("baseline", "clean")} UNION ALL {_two_table_scores("drift", "moved")})
SELECT report, count(*) AS number_of_columns, count(*) FILTER (WHERE score >= 0.1) AS number_of_drifted_columns,
    round(count(*) FILTER (WHERE score >= 0.1) / count(*), 6) AS share_of_drifted_columns, count(*) FILTER (WHERE score >= 0.1) / count(*) >= 0.5 AS dataset_drift,
    coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE score >= 0.1), '') AS drifted FROM s GROUP BY report
"""


@query("monitoring_run", _MONITORING_SQL, "txn")
def monitoring_run(spark, sf_dir):
    found = run_monitoring(
        transactions(spark, sf_dir), "txn_id", "is_fraud", MONITORING, ["txn_amt", "txn_dt", "card1"],
        ["product_cd", "card4", "card6", "p_email"],
        in_reference=_drawn(F.col("txn_id").cast("string")) % 2 == 0,
        drifted_rows=_drawn(F.concat(F.col("txn_id").cast("string"), F.lit(":drift"))) % 4 < 3,
    )
    listed = F.concat_ws(",", "drifted_features.feature").alias("drifted")
    return found.summary.select(
        "report", "number_of_columns", "number_of_drifted_columns", rounded("share_of_drifted_columns"), "dataset_drift", listed
    )


