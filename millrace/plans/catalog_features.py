"""Queries over row features, fitted encodings and preprocessing."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import encoders, joins, profile
from ..operators.scoring import parse_payload
from ..sources.fixtures import REFERENCE_END, table, transactions
from .catalog import query, rounded
from .catalog_tables import slices

# -- row features -------------------------------------------------------------------------


@query(
    "category_normalize",
    """SELECT txn_id, coalesce(CAST(card1 AS VARCHAR), '__missing__') AS card1, coalesce(CAST(addr1 AS VARCHAR), '__missing__') AS addr1,
       coalesce(card4, '__missing__') AS card4, coalesce(CAST(txn_dt AS VARCHAR), '__missing__') AS txn_dt,
       coalesce(CAST(is_fraud AS VARCHAR), '__missing__') AS is_fraud FROM txn""",
    "txn",
)
def category_normalize(spark, sf_dir):
    df = transactions(spark, sf_dir)
    return df.select("txn_id", *[expr.category(df, c).alias(c) for c in ("card1", "addr1", "card4", "txn_dt", "is_fraud")])


@query(
    "interaction_feature",
    """SELECT txn_id, coalesce(card4, '__missing__') || '_' || coalesce(card6, '__missing__') AS card4_x_card6,
       coalesce(CAST(card1 AS VARCHAR), '__missing__') || '_' || coalesce(CAST(addr1 AS VARCHAR), '__missing__') AS card1_x_addr1 FROM txn""",
    "txn",
)
def interaction_feature(spark, sf_dir):
    df = transactions(spark, sf_dir)
    pairs = [("card4", "card6"), ("card1", "addr1")]
    return df.select("txn_id", *[expr.combined_category(df, p).alias("_x_".join(p)) for p in pairs])


def _flags(columns):
    return " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in columns)


_ALL = ["txn_dt", "txn_amt", "product_cd", "card1", "card4", "card6", "addr1", "p_email", "r_email", "ingest_ts"]
_CARD = ["card1", "card4", "card6"]


@query(
    "row_missing_features",
    f"""SELECT txn_id, {_flags(_ALL)} AS missing_total_count, round(({_flags(_ALL)}) / {len(_ALL)}, 8) AS missing_total_ratio,
        {_flags(_CARD)} AS card_missing_count, round(({_flags(_CARD)}) / 3, 8) AS card_missing_ratio,
        {_flags(["addr1"])} AS addr_missing_count, CAST({_flags(["addr1"])} AS DOUBLE) AS addr_missing_ratio FROM txn""",
    "txn",
)
def row_missing_features(spark, sf_dir):
    df = transactions(spark, sf_dir)
    found = expr.missing_features(df, ["card", "addr", "dist"], _ALL)
    return df.select("txn_id", *[(F.round(c, 8) if n.endswith("ratio") else c).alias(n) for n, c in found.items()])


@query(
    "amount_features",
    """SELECT txn_id, round(CASE WHEN txn_amt IS NOT NULL THEN ln(1 + greatest(txn_amt, 0)) END, 8) AS txn_amt_log1p, round_even(coalesce(txn_amt, 0) * 100, 0) % 100 AS txn_amt_cents,
       CASE WHEN round_even(coalesce(txn_amt, 0) * 100, 0) % 100 = 0 THEN 1 ELSE 0 END AS txn_amt_is_round FROM txn""",
    "txn",
)
def amount_features(spark, sf_dir):
    df = transactions(spark, sf_dir)
    found = df.select("txn_id", *[c.alias(n) for n, c in expr.amount_features(df, "txn_amt").items()])
    return found.withColumn("txn_amt_log1p", rounded("txn_amt_log1p", 8))


@query(
    "time_features",
    """, t AS (SELECT txn_id, txn_dt, floor(txn_dt / 3600) % 24 AS h, floor(txn_dt / 86400) % 7 AS w FROM txn)
       SELECT txn_id, round(txn_dt / 86400, 9) AS txn_dt_day, floor(txn_dt / 604800) AS txn_dt_week, h AS txn_dt_hour, w AS txn_dt_weekday,
       round(sin(2 * pi() * h / 24), 6) + 0 AS txn_dt_hour_sin, round(cos(2 * pi() * h / 24), 6) + 0 AS txn_dt_hour_cos,
       round(sin(2 * pi() * w / 7), 6) + 0 AS txn_dt_weekday_sin, round(cos(2 * pi() * w / 7), 6) + 0 AS txn_dt_weekday_cos FROM t""",
    "txn",
)
def time_features(spark, sf_dir):
    df = transactions(spark, sf_dir)
    shown = expr.time_features(df, "txn_dt")
    shown["txn_dt_day"] = F.round(shown["txn_dt_day"], 9)
    shown = {n: F.round(c, 6) + F.lit(0.0) if n.endswith(("sin", "cos")) else c for n, c in shown.items()}
    return df.select("txn_id", *[c.alias(n) for n, c in shown.items()])


@query(
    "email_domain_parts",
    """, e AS (SELECT txn_id, lower(coalesce(p_email, '__missing__')) AS p, lower(coalesce(r_email, '__missing__')) AS r FROM txn)
       SELECT txn_id, split_part(p, '.', 1) AS p_email_root, split_part(p, '.', -1) AS p_email_suffix,
       split_part(r, '.', 1) AS r_email_root, split_part(r, '.', -1) AS r_email_suffix FROM e""",
    "txn",
)
def email_domain_parts(spark, sf_dir):
    df = transactions(spark, sf_dir)
    parts = {**expr.email_parts(df, "p_email"), **expr.email_parts(df, "r_email")}
    return df.select("txn_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "email_domain_match",
    """SELECT txn_id, CASE WHEN p_email IS NOT NULL AND lower(p_email) = lower(coalesce(r_email, '__missing__')) THEN 1 ELSE 0 END
       AS email_domain_match FROM txn""",
    "txn",
)
def email_domain_match(spark, sf_dir):
    df = transactions(spark, sf_dir)
    return df.select("txn_id", expr.email_match(df, "p_email", "r_email").alias("email_domain_match"))


@query("numeric_as_category", "SELECT txn_id, CAST(card1 AS VARCHAR) AS card1, CAST(addr1 AS VARCHAR) AS addr1 FROM txn", "txn")
def numeric_as_category(spark, sf_dir):
    df = transactions(spark, sf_dir)
    return df.select("txn_id", *[expr.value_text(df, c).alias(c) for c in ("card1", "addr1")])


_REF = "txn_dt < 240000000"


@query(
    "amount_vs_group_median",
    """, m AS (SELECT coalesce(card4, '__missing__') AS k, quantile_cont(txn_amt, 0.5) AS med FROM txn GROUP BY 1)
       SELECT txn_id, round(txn_amt / nullif(med, 0), 8) AS ratio, round(txn_amt - med, 4) AS difference
       FROM txn JOIN m ON coalesce(card4, '__missing__') = m.k""",
    "txn",
)
def amount_vs_group_median(spark, sf_dir):
    df = transactions(spark, sf_dir)
    keyed = df.select("txn_id", "txn_amt", expr.category(df, "card4").alias("value"))
    medians = profile.group_median(keyed, "value", "txn_amt").select("value", "median")
    found = joins.lookup(keyed, medians, "value", {"median": None})
    amount, median = F.col("txn_amt"), F.col("median")
    return found.select(
        "txn_id", F.round(expr.group_ratio(amount, median), 8).alias("ratio"), F.round(amount - median, 4).alias("difference")
    )


@query(
    "timestamp_parse",
    """, p AS (SELECT txn_id, TRY_CAST(ingest_ts AS TIMESTAMP) AS ts FROM txn)
       SELECT txn_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS epoch_second,
       round(date_diff('second', ts, TIMESTAMP '1998-06-01 12:00:00') / 86400, 6) AS age_days,
       ts > TIMESTAMP '1998-06-02 12:00:00' AS is_future FROM p""",
    "txn",
)
def timestamp_parse(spark, sf_dir):
    at = F.timestamp_micros(F.lit(int(datetime(1998, 6, 1, 12, tzinfo=UTC).timestamp()) * 1_000_000))
    df = transactions(spark, sf_dir).select("txn_id", expr.parse_utc("ingest_ts").alias("ts"))
    return df.select(
        "txn_id", F.unix_seconds("ts").alias("epoch_second"), F.round(expr.age_days(at, F.col("ts")), 6).alias("age_days"),
        expr.is_future(F.col("ts"), at, 1).alias("is_future"),
    )


@query(
    "payload_validation",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'empty' WHEN event_id % 7 = 0 THEN 'blank_name' WHEN event_id % 5 = 0 THEN 'not_finite' END
       AS reject_reason, CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 THEN event_type END AS kind FROM events""",
)
def payload_validation(spark, sf_dir):
    """Payloads of every event, some with a blank name or an infinite number."""
    key = F.col("event_id")
    name = F.when(key % 7 == 0, " ").otherwise(" kind ")
    number = F.when(key % 5 == 0, F.lit("Infinity")).otherwise(F.col("value").cast("string"))
    features = F.when(key % 11 != 0, F.create_map(name, F.col("event_type"), F.lit("amount"), number))
    checked = expr.check_payload(features)
    return table(spark, sf_dir, "events").select(
        "event_id", checked["reject_reason"].alias("reject_reason"),
        F.try_element_at(checked["features"], F.lit("kind")).alias("kind"),
    )


# -- fitted encodings ------------------------------------------------------------------------

SETTINGS = {
    "use_feature_engineering": True,
    "amount_column": "txn_amt",
    "log_transform_features": ["txn_amt"],
    "use_transaction_time_features": True,
    "transaction_time_column": "txn_dt",
    "categorical_like_numeric_features": ["card1", "addr1"],
    "use_missing_pattern_features": True,
    "missing_indicator_prefixes": ["card", "addr"],
    "use_frequency_encoding": True,
    "frequency_encode_features": ["card1", "p_email"],
    "use_amount_group_features": True,
    "amount_groupby_features": ["product_cd", "card4"],
    "use_target_mean_encoding": True,
    "target_mean_smoothing": 30.0,
    "target_mean_encode_features": ["product_cd", "card4", "addr1"],
    "target_mean_encode_interactions": [["card4", "card6"]],
    "email_domain_features": ["p_email"],
    "email_match_features": ["p_email", "r_email"],
    "interaction_features": [["card4", "card6"]],
}


def _only(**switches) -> dict:
    off = {k: False for k in SETTINGS if k.startswith("use_") and k != "use_feature_engineering"}
    lists = {k: [] for k in ("log_transform_features", "email_domain_features", "email_match_features", "interaction_features", "categorical_like_numeric_features")}
    return {**SETTINGS, **off, **lists, **switches}


def _encoded(spark, sf_dir, settings):
    """Fitted on the reference slice, applied to every row."""
    df = transactions(spark, sf_dir).drop("ingest_ts")
    model = encoders.FeatureEngineer(settings, "is_fraud", ["txn_id"]).fit(df.where(F.col("txn_dt") < REFERENCE_END))
    return model.transform(df)


def _key(c):
    return f"coalesce(CAST({c} AS VARCHAR), '__missing__')"


_GLOBAL = f"g AS (SELECT avg(is_fraud) AS gm, quantile_cont(txn_amt, 0.5) AS gmed, count(*) AS n FROM txn WHERE {_REF})"


@query(
    "frequency_encoding",
    f""", {_GLOBAL}, a AS (SELECT {_key('card1')} AS k, count(*) AS c FROM txn WHERE {_REF} GROUP BY 1),
        b AS (SELECT {_key('p_email')} AS k, count(*) AS c FROM txn WHERE {_REF} GROUP BY 1)
        SELECT txn_id, round(coalesce(a.c, 0) / g.n, 8) AS card1_frequency, round(coalesce(b.c, 0) / g.n, 8) AS p_email_frequency
        FROM txn CROSS JOIN g LEFT JOIN a ON {_key('card1')} = a.k LEFT JOIN b ON {_key('p_email')} = b.k""",
    "txn",
)
def frequency_encoding(spark, sf_dir):
    found = _encoded(spark, sf_dir, _only(use_frequency_encoding=True))
    return found.select("txn_id", rounded("card1_frequency", 8), rounded("p_email_frequency", 8))


@query(
    "group_median_features",
    f""", {_GLOBAL}, a AS (SELECT {_key('product_cd')} AS k, quantile_cont(txn_amt, 0.5) AS m FROM txn WHERE {_REF} GROUP BY 1),
        b AS (SELECT {_key('card4')} AS k, quantile_cont(txn_amt, 0.5) AS m FROM txn WHERE {_REF} GROUP BY 1),
        j AS (SELECT txn_id, txn_amt, coalesce(a.m, CASE WHEN gmed > 0 THEN gmed ELSE 1 END) AS ma, coalesce(b.m, CASE WHEN gmed > 0 THEN gmed ELSE 1 END) AS mb
        FROM txn CROSS JOIN g LEFT JOIN a ON {_key('product_cd')} = a.k LEFT JOIN b ON {_key('card4')} = b.k)
        SELECT txn_id, round(txn_amt / nullif(ma, 0), 8) AS txn_amt_to_product_cd_median, round(txn_amt - ma, 4) AS txn_amt_minus_product_cd_median,
        round(txn_amt / nullif(mb, 0), 8) AS txn_amt_to_card4_median, round(txn_amt - mb, 4) AS txn_amt_minus_card4_median FROM j""",
    "txn",
)
def group_median_features(spark, sf_dir):
    found = _encoded(spark, sf_dir, _only(use_amount_group_features=True))
    return found.select(
        "txn_id", *[rounded(f"txn_amt_to_{g}_median", 8) for g in ("product_cd", "card4")],
        *[rounded(f"txn_amt_minus_{g}_median", 4) for g in ("product_cd", "card4")],
    )


def _mean_cte(name, key):
    return f"{name} AS (SELECT {key} AS k, (sum(is_fraud) + 30.0 * (SELECT gm FROM g)) / (count(*) + 30.0) AS m FROM txn WHERE {_REF} GROUP BY 1)"


@query(
    "target_mean_encoding",
    f""", {_GLOBAL}, {_mean_cte('a', _key('product_cd'))}, {_mean_cte('b', _key('card4'))}, {_mean_cte('c', _key('addr1'))}
        SELECT txn_id, round(coalesce(a.m, gm), 8) AS product_cd_target_mean, round(coalesce(b.m, gm), 8) AS card4_target_mean,
        round(coalesce(c.m, gm), 8) AS addr1_target_mean FROM txn CROSS JOIN g LEFT JOIN a ON {_key('product_cd')} = a.k
        LEFT JOIN b ON {_key('card4')} = b.k LEFT JOIN c ON {_key('addr1')} = c.k""",
    "txn",
)
def target_mean_encoding(spark, sf_dir):
    settings = _only(use_target_mean_encoding=True, target_mean_encode_interactions=[])
    found = _encoded(spark, sf_dir, settings)
    return found.select("txn_id", *[rounded(f"{c}_target_mean", 8) for c in ("product_cd", "card4", "addr1")])


_PAIR = f"{_key('card4')} || '_' || {_key('card6')}"


@query(
    "target_mean_interaction",
    f""", {_GLOBAL}, {_mean_cte('a', _PAIR)}
        SELECT txn_id, round(coalesce(a.m, gm), 8) AS card4_x_card6_target_mean FROM txn CROSS JOIN g LEFT JOIN a ON {_PAIR} = a.k""",
    "txn",
)
def target_mean_interaction(spark, sf_dir):
    found = _encoded(spark, sf_dir, _only(use_target_mean_encoding=True, target_mean_encode_features=[]))
    return found.select("txn_id", rounded("card4_x_card6_target_mean", 8))


@query(
    "engineered_features",
    f""", {_GLOBAL}, {_mean_cte('a', _key('product_cd'))}, {_mean_cte('x', _PAIR)},
        f AS (SELECT {_key('card1')} AS k, count(*) AS c FROM txn WHERE {_REF} GROUP BY 1),
        m AS (SELECT {_key('card4')} AS k, quantile_cont(txn_amt, 0.5) AS m FROM txn WHERE {_REF} GROUP BY 1)
        SELECT txn_id, CAST(addr1 AS VARCHAR) AS addr1, {_flags([c for c in _ALL if c != "ingest_ts"])} AS missing_total_count,
        round_even(coalesce(txn_amt, 0) * 100, 0) % 100 AS txn_amt_cents, floor(txn_dt / 3600) % 24 AS txn_dt_hour,
        round(coalesce(f.c, 0) / g.n, 8) AS card1_frequency, round(coalesce(a.m, gm), 8) AS product_cd_target_mean,
        round(coalesce(x.m, gm), 8) AS card4_x_card6_target_mean, round(txn_amt / nullif(coalesce(m.m, gmed), 0), 8) AS txn_amt_to_card4_median,
        split_part(lower(coalesce(p_email, '__missing__')), '.', -1) AS p_email_suffix,
        CASE WHEN p_email IS NOT NULL AND lower(p_email) = lower(coalesce(r_email, '__missing__')) THEN 1 ELSE 0 END AS email_domain_match,
        {_PAIR} AS card4_x_card6
        FROM txn CROSS JOIN g LEFT JOIN a ON {_key('product_cd')} = a.k LEFT JOIN x ON {_PAIR} = x.k LEFT JOIN f ON {_key('card1')} = f.k
        LEFT JOIN m ON {_key('card4')} = m.k""",
    "txn",
)
def engineered_features(spark, sf_dir):
    found = _encoded(spark, sf_dir, SETTINGS)
    return found.select(
        "txn_id", "addr1", "missing_total_count", "txn_amt_cents", "txn_dt_hour", rounded("card1_frequency", 8),
        rounded("product_cd_target_mean", 8), rounded("card4_x_card6_target_mean", 8), rounded("txn_amt_to_card4_median", 8),
        "p_email_suffix", "email_domain_match", "card4_x_card6",
    )


# -- columns ------------------------------------------------------------------------------------


def _numeric(spark, sf_dir, columns, **settings):
    df = transactions(spark, sf_dir)
    fitted = encoders.fit_numeric(df.where(F.col("txn_dt") < REFERENCE_END), columns, settings)
    values = encoders.numeric_outputs(df, fitted)
    return df.select("txn_id", *[F.round(c, 6).alias(n) for n, c in values.items()])


@query(
    "impute_median",
    f""", m AS (SELECT quantile_cont(txn_amt, 0.5) AS a, quantile_cont(addr1, 0.5) AS b FROM txn WHERE {_REF})
        SELECT txn_id, round(coalesce(txn_amt, a), 6) AS txn_amt, round(coalesce(addr1, b), 6) AS addr1,
        CASE WHEN txn_amt IS NULL THEN 1.0::DOUBLE ELSE 0 END AS txn_amt_missing, CASE WHEN addr1 IS NULL THEN 1.0::DOUBLE ELSE 0 END AS addr1_missing FROM txn, m""",
    "txn",
)
def impute_median(spark, sf_dir):
    return _numeric(spark, sf_dir, ["txn_amt", "addr1"], strategy="median", add_indicator=True)


@query("impute_constant", "SELECT txn_id, coalesce(card4, 'missing') AS card4, coalesce(p_email, 'missing') AS p_email FROM txn", "txn")
def impute_constant(spark, sf_dir):
    """The encoder's one-hot vectors, read back as the values their slots stand for."""
    names = ["card4", "p_email"]
    df = transactions(spark, sf_dir).select("txn_id", *names)
    model = encoders.CategoryEncoder({"strategy": "constant", "fill_value": "missing"}, names).fit(df)
    found = model.transform(df).select("txn_id", vector_to_array("category_vector").alias("hot"))
    for c in names:
        rows, text_bytes = model.get_fitted()["size"][c]
        at = F.array_position(F.slice("hot", model.get_fitted()["offset"][c] + 1, rows), F.lit(1.0)) - 1
        values = model.tables["slots"].where(F.col("column") == c).select(F.col("slot").cast("long").alias("at"), F.col("value").alias(c))
        found = found.withColumn("at", at).join(joins.sized(values, rows, text_bytes), "at", "left").drop("at")
    return found.select("txn_id", *names)


@query(
    "robust_scale",
    f""", m AS (SELECT quantile_cont(txn_amt, 0.5) AS a FROM txn WHERE {_REF}),
        i AS (SELECT coalesce(txn_amt, a) AS x, CASE WHEN txn_amt IS NULL THEN 1.0 ELSE 0.0 END AS f FROM txn, m WHERE {_REF}),
        s AS (SELECT quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w, quantile_cont(f, 0.5) AS fc,
              quantile_cont(f, 0.75) - quantile_cont(f, 0.25) AS fw FROM i)
        SELECT txn_id, round((coalesce(txn_amt, a) - c) / CASE WHEN w = 0 THEN 1 ELSE w END, 6) AS txn_amt,
        round(CAST((CASE WHEN txn_amt IS NULL THEN 1.0 ELSE 0.0 END - fc) AS DOUBLE) / CASE WHEN fw = 0 THEN 1 ELSE fw END, 6) AS txn_amt_missing FROM txn, m, s""",
    "txn",
)
def robust_scale(spark, sf_dir):
    return _numeric(spark, sf_dir, ["txn_amt"], strategy="median", scaler="robust", add_indicator=True)


@query(
    "standard_scale",
    f""", m AS (SELECT quantile_cont(txn_amt, 0.5) AS a FROM txn WHERE {_REF}),
        s AS (SELECT avg(coalesce(txn_amt, a)) AS c, stddev_pop(coalesce(txn_amt, a)) AS w, avg(card1) AS c1, stddev_pop(card1) AS w1 FROM txn, m WHERE {_REF})
        SELECT txn_id, round((coalesce(txn_amt, a) - c) / w, 6) AS txn_amt, round((card1 - c1) / w1, 6) AS card1 FROM txn, m, s""",
    "txn",
)
def standard_scale(spark, sf_dir):
    return _numeric(spark, sf_dir, ["txn_amt", "card1"], strategy="median", scaler="standard")


def _slots_sql(c, least, most):
    return f""", n AS (SELECT coalesce(CAST({c} AS VARCHAR), 'missing') AS value, count(*) AS n FROM txn GROUP BY 1),
        k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS r FROM n WHERE n >= {least}),
        z AS (SELECT (SELECT count(*) FROM n) AS a, (SELECT count(*) FROM k) AS b),
        t AS (SELECT value, n FROM k, z WHERE r <= CASE WHEN a = b AND b <= {most} THEN {most} ELSE {most} - 1 END),
        f AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS slot FROM t)
        SELECT '{c}' AS "column", n.value, n.n, f.slot IS NULL AS is_infrequent,
        CAST(coalesce(f.slot, (SELECT count(*) FROM f)) AS INTEGER) AS slot FROM n LEFT JOIN f ON n.value = f.value"""


@query("one_hot_categories", _slots_sql("addr1", 5, 10), "txn")
def one_hot_categories(spark, sf_dir):
    return encoders.category_slots(transactions(spark, sf_dir), ["addr1"], "missing", 5, 10)


@query(
    "polynomial_features",
    """SELECT txn_id, round(card1, 4) AS card1, round(coalesce(addr1, 0), 4) AS addr1, round(card1 * card1, 4) AS card1_card1,
       round(card1 * coalesce(addr1, 0), 4) AS card1_addr1, round(coalesce(addr1, 0) * coalesce(addr1, 0), 4) AS addr1_addr1 FROM txn""",
    "txn",
)
def polynomial_features(spark, sf_dir):
    df = transactions(spark, sf_dir).select("txn_id", F.lit(0).alias("is_fraud"), "card1", F.coalesce("addr1", F.lit(0.0)).alias("addr1"))
    settings = {"numeric_imputer_strategy": "median", "use_polynomial_features": True, "polynomial_degree": 2}
    fitted = encoders.build_preprocessing(settings, "is_fraud", ["txn_id"]).fit(df)
    expanded = fitted.transform(df).select("txn_id", vector_to_array("features").alias("t"))
    names = ["card1", "card1_card1", "addr1", "card1_addr1", "addr1_addr1"]
    return expanded.select("txn_id", *[F.round(F.col("t")[i], 4).alias(n) for i, n in enumerate(names)])


@query(
    "variance_filter",
    """SELECT 'txn_amt' AS "column", round(var_pop(coalesce(txn_amt, 0)) / 1e6, 4) AS variance, TRUE AS kept FROM txn UNION ALL
       SELECT 'card1', round(var_pop(card1) / 1e6, 4), TRUE FROM txn UNION ALL SELECT 'constant', 0.0, FALSE FROM (SELECT count(*) FROM txn)""",
    "txn",
)
def variance_filter(spark, sf_dir):
    names = ["txn_amt", "card1", "constant"]
    df = transactions(spark, sf_dir).select("is_fraud", F.coalesce("txn_amt", F.lit(0.0)).alias("txn_amt"), "card1", F.lit(7.0).alias("constant"))
    wide = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    _, variance = encoders.anova_f(encoders.class_moments(wide, "v", "is_fraud"))
    kept = set(encoders.FeatureSelector(None, True, "is_fraud", "v").fit(wide).getIndices())
    rows = [(n, round(float(variance[i]) / 1e6, 4), i in kept) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "column string, variance double, kept boolean")


def _anova_sql(c):
    return f"""SELECT '{c}' AS "column", round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS f_score FROM
      (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) * count({c}) AS w, (SELECT avg({c}) FROM txn) AS g FROM txn GROUP BY is_fraud)"""


@query("anova_f_scores", " UNION ALL ".join(_anova_sql(c) for c in ("txn_amt", "txn_dt", "card1", "addr1")), "txn")
def anova_f_scores(spark, sf_dir):
    found = encoders.anova_scores(transactions(spark, sf_dir), ["txn_amt", "txn_dt", "card1", "addr1"], "is_fraud")
    return found.withColumn("f_score", rounded("f_score"))


PREPROCESSING = {
    **SETTINGS,
    "numeric_imputer_strategy": "median",
    "numeric_add_missing_indicator": True,
    "categorical_imputer_strategy": "constant",
    "categorical_fill_value": "missing",
    "scaler": "robust",
    "encoder_max_categories": 10,
    "encoder_min_frequency": 5,
    "use_variance_threshold": True,
    "use_feature_selection": True,
    "feature_selection_k": 40,
}


@query("preprocessing")
def preprocessing(spark, sf_dir):
    reference, _ = slices(spark, sf_dir)
    model = encoders.build_preprocessing(PREPROCESSING, "is_fraud", ["txn_id", "ingest_ts"]).fit(reference)
    out = model.transform(transactions(spark, sf_dir))
    return out.select("txn_id", "is_fraud", F.size(vector_to_array("features")).alias("width"), vector_to_array("features").alias("features"))


@query(
    "parse_payload",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS k,
       CASE WHEN event_id % 13 <> 0 THEN event_type END AS kind FROM events""",
)
def parse_payloads(spark, sf_dir):
    """Plain and nested payloads, and some that are no JSON."""
    key = F.col("event_id")
    inner = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    text = F.when(key % 13 == 0, F.lit("{broken")).when(key % 2 == 0, F.concat(F.lit('{"features": '), inner, F.lit("}"))).otherwise(inner)
    df = table(spark, sf_dir, "events").select("event_id", parse_payload(text).alias("f"))
    at = lambda n: F.try_element_at("f", F.lit(n)).alias(n)
    return df.select("event_id", at("k"), at("kind"))
