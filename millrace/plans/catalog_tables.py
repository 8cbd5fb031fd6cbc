"""Queries over scans, projections, joins, aggregates, windows and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import to_number
from ..operators import joins, profile, split
from ..operators.drift import two_sample_steps
from ..operators.evaluation import cumulative_confusion
from ..session import scratch_path
from ..sources.fixtures import REFERENCE_END, identities, scores, table, transactions
from ..sources.tables import bounded_scan, read_table
from .catalog import query, rounded


def slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    txn = transactions(spark, sf_dir)
    return txn.where(F.col("txn_dt") < REFERENCE_END), txn.where(F.col("txn_dt") >= REFERENCE_END)


# -- scans ------------------------------------------------------------------------------


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".csv"
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    wanted.write.option("header", True).csv(path)
    return read_table(spark, path, schema=wanted.schema)


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_parquet(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("scan_jsonl", "SELECT event_id, event_type, value, props FROM events")
def scan_jsonl(spark, sf_dir):
    path = scratch_path(spark, "events") + ".jsonl"
    wanted = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    wanted.write.json(path)
    return read_table(spark, path, schema=wanted.schema)


@query("bounded_scan", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def bounded(spark, sf_dir):
    return bounded_scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")


# -- projections ------------------------------------------------------------------------


@query("feature_projection", "SELECT * EXCLUDE (txn_id, is_fraud) FROM txn", "txn")
def feature_projection(spark, sf_dir):
    return profile.feature_projection(transactions(spark, sf_dir), "is_fraud", "txn_id")


@query(
    "coerce_numeric",
    """SELECT txn_id, TRY_CAST(CASE WHEN txn_id % 7 = 0 THEN 'n/a' WHEN txn_id % 7 = 1 THEN CAST(txn_id AS VARCHAR) || '.25'
       ELSE CAST(txn_id AS VARCHAR) END AS DOUBLE) AS number FROM txn""",
    "txn",
)
def coerce_numeric(spark, sf_dir):
    key = F.col("txn_id")
    raw = F.when(key % 7 == 0, "n/a").when(key % 7 == 1, F.concat(key.cast("string"), F.lit(".25"))).otherwise(key.cast("string"))
    df = transactions(spark, sf_dir).select("txn_id", raw.alias("raw"))
    return df.select("txn_id", to_number(df, "raw").alias("number"))


@query(
    "group_rate_min_support",
    """SELECT p_email, count(*) AS n, round(avg(is_fraud) * 100, 6) AS rate_pct FROM txn
       WHERE p_email IS NOT NULL GROUP BY p_email HAVING count(*) >= 500""",
    "txn",
)
def group_rate_min_support(spark, sf_dir):
    return profile.rate_with_support(transactions(spark, sf_dir), "p_email", "is_fraud").withColumn("rate_pct", rounded("rate_pct"))


@query("available_columns", "SELECT txn_id, txn_amt, product_cd, card4 FROM txn", "txn")
def available_columns(spark, sf_dir):
    return profile.available(transactions(spark, sf_dir), ["txn_id", "txn_amt", "dist1", "product_cd", "card4", "DeviceType"])


# -- joins ------------------------------------------------------------------------------


@query(
    "left_join_identity",
    """SELECT t.txn_id, t.card1, i.c_name AS device, i.c_acctbal FROM txn t
       LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 = 0) i ON t.card1 = CAST(i.c_custkey AS DOUBLE)""",
    "txn",
)
def left_join_identity(spark, sf_dir):
    joined = joins.left_join_optional(transactions(spark, sf_dir), identities(spark, sf_dir), "card1")
    return joined.select("txn_id", "card1", "device", "c_acctbal")


@query(
    "lookup_with_default",
    """, m AS (SELECT c_mktsegment AS card4, count(*) AS members FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1)
       SELECT t.txn_id, t.card4, coalesce(m.members, 0) AS members FROM txn t LEFT JOIN m ON t.card4 = m.card4""",
    "txn",
)
def lookup_with_default(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'")
    members = customers.groupBy(F.col("c_mktsegment").alias("card4")).agg(F.count(F.lit(1)).alias("members"))
    txn = transactions(spark, sf_dir).select("txn_id", "card4")
    return joins.lookup(txn, members, "card4", {"members": 0})


@query(
    "align_distributions",
    """, a AS (SELECT p_email AS value, count(*) / sum(count(*)) OVER () AS p FROM txn WHERE txn_dt < 240000000 AND p_email IS NOT NULL
              AND p_email <> 'Mail' GROUP BY 1),
       b AS (SELECT r_email AS value, count(*) / sum(count(*)) OVER () AS q FROM txn WHERE txn_dt >= 240000000 AND r_email IS NOT NULL GROUP BY 1)
       SELECT coalesce(a.value, b.value) AS value, round(coalesce(p, 0), 8) AS p, round(coalesce(q, 0), 8) AS q
       FROM a FULL JOIN b ON a.value = b.value""",
    "txn",
)
def align_distributions(spark, sf_dir):
    reference, current = slices(spark, sf_dir)
    left = joins.category_shares(reference.where("p_email <> 'Mail'"), "p_email")
    both = joins.align_distributions(left, joins.category_shares(current, "r_email"))
    return both.select("value", rounded("p", 8), rounded("q", 8))


@query(
    "anti_new_categories",
    """SELECT DISTINCT r_email AS value FROM txn WHERE txn_dt >= 240000000 AND r_email IS NOT NULL
       AND r_email NOT IN (SELECT p_email FROM txn WHERE txn_dt < 240000000 AND p_email IS NOT NULL)""",
    "txn",
)
def anti_new_categories(spark, sf_dir):
    reference, current = slices(spark, sf_dir)
    known = reference.select(F.col("p_email").alias("value")).where("value IS NOT NULL")
    return joins.anti_categories(current.select(F.col("r_email").alias("value")).where("value IS NOT NULL"), known)


@query(
    "compare_distribution_topn",
    """, a AS (SELECT CAST(addr1 AS VARCHAR) AS value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM txn
              WHERE txn_dt < 240000000 AND addr1 IS NOT NULL GROUP BY 1),
       b AS (SELECT CAST(addr1 AS VARCHAR) AS value, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM txn
              WHERE txn_dt >= 240000000 AND addr1 IS NOT NULL GROUP BY 1),
       top AS (SELECT * FROM a ORDER BY n DESC, value LIMIT 10)
       SELECT top.value, round(top.pct, 6) AS reference_pct, round(coalesce(b.pct, 0), 6) AS current_pct FROM top LEFT JOIN b ON top.value = b.value""",
    "txn",
)
def compare_distribution_topn(spark, sf_dir):
    found = joins.top_n_alignment(*slices(spark, sf_dir), "addr1", 10)
    return found.select("value", rounded("reference_pct"), rounded("current_pct"))


# -- aggregates -------------------------------------------------------------------------


@query(
    "value_shares",
    "SELECT product_cd AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM txn WHERE product_cd IS NOT NULL GROUP BY 1",
    "txn",
)
def value_shares(spark, sf_dir):
    return profile.value_shares(transactions(spark, sf_dir), "product_cd").withColumn("share", rounded("share", 8))


@query(
    "target_rate_by_category",
    "SELECT card4, count(*) AS n, round(avg(is_fraud) * 100, 6) AS rate_pct FROM txn WHERE card4 IS NOT NULL GROUP BY card4",
    "txn",
)
def target_rate_by_category(spark, sf_dir):
    return profile.target_rate(transactions(spark, sf_dir), "card4", "is_fraud").withColumn("rate_pct", rounded("rate_pct"))


@query(
    "distinct_counts",
    """SELECT 'card1' AS "column", count(DISTINCT card1) AS n_distinct FROM txn UNION ALL SELECT 'card4', count(DISTINCT card4) FROM txn
       UNION ALL SELECT 'p_email', count(DISTINCT p_email) FROM txn UNION ALL SELECT 'txn_amt', count(DISTINCT txn_amt) FROM txn
       UNION ALL SELECT 'ingest_ts', count(DISTINCT ingest_ts) FROM txn""",
    "txn",
)
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(transactions(spark, sf_dir), ["card1", "card4", "p_email", "txn_amt", "ingest_ts"])


@query(
    "group_median",
    """SELECT card4 AS value, count(txn_amt) AS n, round(quantile_cont(txn_amt, 0.5), 6) AS median FROM txn
       WHERE card4 IS NOT NULL GROUP BY card4""",
    "txn",
)
def group_median(spark, sf_dir):
    return profile.group_median(transactions(spark, sf_dir), "card4", "txn_amt").withColumn("median", rounded("median"))


def _profile_sql(c: str, where: str = "TRUE", extra: str = "") -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {n}" for p, n in
                  ((0.01, "q01"), (0.05, "q05"), (0.5, "q50"), (0.95, "q95"), (0.99, "q99")))
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(1 - count({c}) / count(*), 6) AS missing_fraction, "
        f"round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, {q}{extra} "
        f"FROM txn WHERE {where}"
    )


PROFILE_STATS = ["mean", "std", "min", "max", "q01", "q05", "q50", "q95", "q99"]


def shown_profile(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in PROFILE_STATS})


@query("numeric_profile", " UNION ALL ".join(_profile_sql(c) for c in ("txn_amt", "txn_dt", "card1")), "txn")
def numeric_profile(spark, sf_dir):
    return shown_profile(profile.numeric_profile(transactions(spark, sf_dir), ["txn_amt", "txn_dt", "card1"]))


def _category_profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", d.value, d.share, s.count, s.missing_fraction, s.unique_count FROM
      (SELECT coalesce({c}, '__missing__') AS value, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM txn GROUP BY 1
       QUALIFY row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, '__missing__')) <= 100) d,
      (SELECT count({c}) AS count, round(1 - count({c}) / count(*), 6) AS missing_fraction, count(DISTINCT {c}) AS unique_count FROM txn) s"""


@query("categorical_profile", " UNION ALL ".join(_category_profile_sql(c) for c in ("card4", "p_email", "ingest_ts")), "txn")
def categorical_profile(spark, sf_dir):
    return profile.categorical_profile(transactions(spark, sf_dir), ["card4", "p_email", "ingest_ts"])


@query(
    "describe_by_group",
    """SELECT card6, count(txn_amt) AS count, round(avg(txn_amt), 4) AS mean, round(stddev_samp(txn_amt), 4) AS std, min(txn_amt) AS min,
       max(txn_amt) AS max, round(quantile_cont(txn_amt, 0.25), 4) AS q25, round(quantile_cont(txn_amt, 0.5), 4) AS q50,
       round(quantile_cont(txn_amt, 0.75), 4) AS q75 FROM txn GROUP BY card6""",
    "txn",
)
def describe_by_group(spark, sf_dir):
    found = profile.describe(transactions(spark, sf_dir), "txn_amt", "card6")
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


TXN_COLUMNS = ["txn_id", "is_fraud", "txn_dt", "txn_amt", "product_cd", "card1", "card4", "card6", "addr1", "p_email", "r_email", "ingest_ts"]
_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round((1 - count({c}) / count(*)) * 100, 6) AS missing_pct FROM txn" for c in TXN_COLUMNS
)


@query("missing_by_column", _MISSING_SQL, "txn")
def missing_by_column(spark, sf_dir):
    return profile.missing_by_column(transactions(spark, sf_dir)).withColumn("missing_pct", rounded("missing_pct"))


@query(
    "missing_rate_buckets",
    f""", m AS ({_MISSING_SQL}) SELECT CASE WHEN missing_pct <= 10 THEN '0-10%' WHEN missing_pct <= 30 THEN '10-30%'
        WHEN missing_pct <= 50 THEN '30-50%' WHEN missing_pct <= 70 THEN '50-70%' ELSE '70-100%' END AS bucket,
        count(*) AS n_columns FROM m GROUP BY 1""",
    "txn",
)
def missing_rate_buckets(spark, sf_dir):
    return profile.missing_rate_buckets(transactions(spark, sf_dir))


@query(
    "skewness_adjusted",
    """SELECT 'txn_amt' AS "column", round(skewness(txn_amt), 6) AS skewness FROM txn
       UNION ALL SELECT 'card1', round(skewness(card1), 6) FROM txn UNION ALL SELECT 'is_fraud', round(skewness(is_fraud), 6) FROM txn""",
    "txn",
)
def skewness_adjusted(spark, sf_dir):
    return profile.skewness(transactions(spark, sf_dir), ["txn_amt", "card1", "is_fraud"]).withColumn("skewness", rounded("skewness"))


_CORR = ["is_fraud", "txn_dt", "txn_amt", "card1", "addr1"]


@query(
    "correlation_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM txn"
        for i, a in enumerate(_CORR) for b in _CORR[i + 1:]
    ),
    "txn",
)
def correlation_pairs(spark, sf_dir):
    return profile.correlations(transactions(spark, sf_dir), _CORR).withColumn("corr", rounded("corr"))


@query(
    "equal_width_histogram",
    """, e AS (SELECT min(txn_amt) AS lo, (max(txn_amt) - min(txn_amt)) / 100 AS w FROM txn)
       SELECT CAST(least(floor((txn_amt - lo) / w), 99) AS INTEGER) AS bin, round(lo + CAST(least(floor((txn_amt - lo) / w), 99) AS INTEGER) * w, 4) AS left_edge,
       count(*) AS n FROM txn, e WHERE txn_amt IS NOT NULL GROUP BY 1, 2""",
    "txn",
)
def equal_width_histogram(spark, sf_dir):
    return profile.histogram(transactions(spark, sf_dir), "txn_amt", 100).withColumn("left_edge", rounded("left_edge", 4))


# -- ordered ----------------------------------------------------------------------------


@query(
    "target_rate_by_quantile_bin",
    """, e AS (SELECT list_sort(list_distinct(quantile_cont(txn_dt, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM txn)
       SELECT CAST(len(list_filter(edges[2:len(edges) - 1], lambda v: v < txn_dt)) AS INTEGER) AS bin, count(*) AS n,
       round(avg(is_fraud) * 100, 6) AS rate_pct FROM txn, e WHERE txn_dt IS NOT NULL GROUP BY 1""",
    "txn",
)
def target_rate_by_quantile_bin(spark, sf_dir):
    return profile.rate_by_quantile_bin(transactions(spark, sf_dir), "txn_dt", "is_fraud", 10).withColumn("rate_pct", rounded("rate_pct"))


@query(
    "duplicate_members",
    "SELECT txn_id, card1, card4 FROM (SELECT *, count(*) OVER (PARTITION BY card1, product_cd, card4) AS c FROM txn) WHERE c > 1",
    "txn",
)
def duplicate_members(spark, sf_dir):
    return joins.duplicate_members(transactions(spark, sf_dir), ["card1", "product_cd", "card4"]).select("txn_id", "card1", "card4")


@query(
    "ecdf_difference",
    """, c AS (SELECT txn_amt AS x, count(*) FILTER (WHERE txn_dt < 240000000) AS a, count(*) FILTER (WHERE txn_dt >= 240000000) AS b
              FROM txn WHERE txn_amt IS NOT NULL GROUP BY 1),
       r AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS g FROM c)
       SELECT x, round(f, 8) AS f, round(g, 8) AS g, round(abs(f - g), 8) AS gap FROM r""",
    "txn",
)
def ecdf_difference(spark, sf_dir):
    steps, _ = two_sample_steps(*slices(spark, sf_dir), ["txn_amt"])
    return steps.select("x", rounded("f", 8), rounded("g", 8), F.round(F.abs(F.col("f") - F.col("g")), 8).alias("gap"))


@query(
    "cumulative_confusion",
    """, c AS (SELECT score, count(*) FILTER (WHERE is_fraud = 1) AS p, count(*) FILTER (WHERE is_fraud = 0) AS n FROM scored GROUP BY 1)
       SELECT round(score, 10) AS score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM c""",
    "scored",
)
def cumulative(spark, sf_dir):
    return cumulative_confusion(scores(spark, sf_dir), "is_fraud").select(rounded("score", 10), "tp", "fp")


@query(
    "rank_scores",
    """, g AS (SELECT product_cd || '-' || card6 AS params, round(avg(is_fraud), 3) AS mean_score FROM txn GROUP BY 1)
       SELECT params, mean_score, CAST(rank() OVER (ORDER BY mean_score DESC) AS INTEGER) AS rank FROM g""",
    "txn",
)
def rank_scores(spark, sf_dir):
    params = F.concat_ws("-", "product_cd", "card6").alias("params")
    means = transactions(spark, sf_dir).groupBy(params).agg(F.round(F.avg("is_fraud"), 3).alias("mean_score"))
    return split.ranked_scores(means, "mean_score")


# -- sort, split, sample ------------------------------------------------------------------


@query(
    "top_k_categories",
    """SELECT CAST(addr1 AS VARCHAR) AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM txn
       WHERE addr1 IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 15""",
    "txn",
)
def top_k_categories(spark, sf_dir):
    return profile.top_categories(transactions(spark, sf_dir), "addr1", 15).withColumn("share", rounded("share", 8))


@query(
    "temporal_split",
    """SELECT txn_id, CASE WHEN row_number() OVER (ORDER BY txn_dt, txn_id) <= floor((SELECT count(*) FROM txn) * 0.70) THEN 'reference'
       ELSE 'current' END AS side FROM txn""",
    "txn",
)
def temporal_split(spark, sf_dir):
    early, late = split.temporal_split(transactions(spark, sf_dir), "txn_dt", "txn_id")
    side = lambda df, name: df.select("txn_id", F.lit(name).alias("side"))
    return side(early, "reference").union(side(late, "current"))


@query(
    "stratified_split",
    """, c AS (SELECT is_fraud, count(*) AS n FROM txn GROUP BY 1), t AS (SELECT sum(n) AS total, ceil(sum(n) * 0.2) AS want FROM c),
       q AS (SELECT is_fraud, n, floor(n * want / total) AS base, n * want / total - floor(n * want / total) AS part, want FROM c, t),
       r AS (SELECT *, row_number() OVER (ORDER BY part DESC, is_fraud) AS k, want - sum(base) OVER () AS rest FROM q),
       z AS (SELECT is_fraud, n, CAST(base + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS test FROM r)
       SELECT is_fraud, 'test' AS side, test AS n FROM z UNION ALL SELECT is_fraud, 'train', n - test FROM z""",
    "txn",
)
def stratified_split(spark, sf_dir):
    flagged = split.with_test_flag(transactions(spark, sf_dir), "is_fraud", "txn_id", 0.2, 42)
    side = F.when(F.col("piece") == 0, "test").otherwise("train").alias("side")
    return flagged.groupBy("is_fraud", side).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_kfold",
    """, c AS (SELECT is_fraud, count(*) AS n FROM txn GROUP BY 1)
       SELECT is_fraud, CAST(f AS INTEGER) AS fold, n // 4 + CASE WHEN f < n % 4 THEN 1 ELSE 0 END AS n FROM c, range(4) r(f)""",
    "txn",
)
def stratified_kfold(spark, sf_dir):
    dealt = split.assign_folds(transactions(spark, sf_dir), "is_fraud", "txn_id", 4, 42)
    return dealt.groupBy("is_fraud", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reference_current_slices",
    """, n AS (SELECT least(count(*), 10000) AS needed FROM txn)
       SELECT 'reference' AS slice, needed // 2 AS n FROM n UNION ALL SELECT 'current', needed - needed // 2 FROM n""",
    "txn",
)
def reference_current_slices(spark, sf_dir):
    return split.monitoring_slices(transactions(spark, sf_dir), "txn_id", 5000, 42).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query(
    "best_run",
    """, runs AS (SELECT 'run-' || product_cd AS run_id, round(avg(is_fraud), 8) AS f1, CASE WHEN product_cd = '5' THEN 'FAILED' ELSE 'FINISHED' END AS status
              FROM txn GROUP BY product_cd)
       SELECT run_id, f1, status FROM runs WHERE status = 'FINISHED' ORDER BY f1 DESC, run_id LIMIT 1""",
    "txn",
)
def best_run(spark, sf_dir):
    runs = transactions(spark, sf_dir).groupBy("product_cd").agg(F.round(F.avg("is_fraud"), 8).alias("f1"))
    status = F.when(F.col("product_cd") == "5", "FAILED").otherwise("FINISHED")
    runs = runs.select(F.concat(F.lit("run-"), "product_cd").alias("run_id"), "f1", status.alias("status"))
    return split.best_run(runs, "f1")


@query(
    "nth_record",
    """SELECT txn_id AS row_key, product_cd, card4, txn_amt FROM (SELECT *, row_number() OVER (ORDER BY txn_id) AS k FROM txn) WHERE k = 1235""",
    "txn",
)
def nth_record(spark, sf_dir):
    found = split.nth_record(transactions(spark, sf_dir), "txn_id", 1234, ["is_fraud", "txn_id"])
    field = lambda n: F.get_json_object("record", f"$.{n}").alias(n)
    return found.select("row_key", field("product_cd"), field("card4"), field("txn_amt").cast("double").alias("txn_amt"))


@query(
    "category_set_ops",
    """, a AS (SELECT DISTINCT p_email AS value FROM txn WHERE txn_dt < 240000000 AND p_email IS NOT NULL),
       b AS (SELECT DISTINCT r_email AS value FROM txn WHERE txn_dt >= 240000000 AND r_email IS NOT NULL),
       d AS (SELECT value FROM b EXCEPT SELECT value FROM a)
       SELECT value, value IN (SELECT value FROM d) AS is_new, value IN (SELECT value FROM d ORDER BY value LIMIT 25) AS is_listed
       FROM (SELECT value FROM a UNION SELECT value FROM b)""",
    "txn",
)
def category_set_ops(spark, sf_dir):
    reference, current = slices(spark, sf_dir)
    return joins.category_sets(reference.select("p_email"), current.select(F.col("r_email").alias("p_email")), "p_email")
