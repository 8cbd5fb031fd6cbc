"""The transaction view: orders and customers with deterministic defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAUD_AMOUNT = 450000
REFERENCE_END = 240000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; join strategy is left to Spark, as both sides grow."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.join(c, cust == F.col("c_custkey"), "left").select(
        key.alias("txn_id"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > FRAUD_AMOUNT), 1).otherwise(0).alias("is_fraud"),
        (days * 86400 + (key * 7919) % 86400).cast("double").alias("txn_dt"),
        F.when(key % 17 != 0, F.col("o_totalprice")).alias("txn_amt"),
        F.substring("o_orderpriority", 1, 1).alias("product_cd"),
        cust.cast("double").alias("card1"),
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("card4"),
        F.when(key % 3 == 0, "credit").otherwise("debit").alias("card6"),
        F.when(key % 13 != 0, F.col("c_nationkey").cast("double")).alias("addr1"),
        F.when(cust % 5 == 0, "gmail.com").when(cust % 5 == 1, "yahoo.co.uk").when(cust % 5 == 2, "Mail")
        .when(cust % 5 == 3, "anonymous.com").alias("p_email"),
        F.when(key % 4 == 0, "gmail.com").when(key % 4 == 1, "aol.com").when(key % 4 == 2, "yahoo.co.uk").alias("r_email"),
        F.when(key % 97 == 0, "not-a-date").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("ingest_ts"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side table that covers only some customers."""
    return table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(
        F.col("c_custkey").cast("double").alias("card1"), F.col("c_name").alias("device"), "c_acctbal"
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a deterministic score, for evaluation without a model."""
    return transactions(spark, sf_dir).select(
        "*", (F.coalesce(F.col("txn_amt"), F.lit(0.0)) / 500000).alias("score")
    )


# The same view for the SQL check.
TXN_SQL = """txn AS (
SELECT o.o_orderkey AS txn_id,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_totalprice > 450000 THEN 1 ELSE 0 END AS is_fraud,
  CAST(date_diff('day', DATE '1992-01-01', CAST(o.o_orderdate AS DATE)) * 86400 + (o.o_orderkey * 7919) % 86400 AS DOUBLE) AS txn_dt,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_totalprice END AS txn_amt,
  substr(o.o_orderpriority, 1, 1) AS product_cd,
  CAST(o.o_custkey AS DOUBLE) AS card1,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS card4,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'credit' ELSE 'debit' END AS card6,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(c.c_nationkey AS DOUBLE) END AS addr1,
  CASE o.o_custkey % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.co.uk' WHEN 2 THEN 'Mail'
    WHEN 3 THEN 'anonymous.com' ELSE NULL END AS p_email,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'aol.com' WHEN 2 THEN 'yahoo.co.uk' ELSE NULL END AS r_email,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'not-a-date' ELSE CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) END AS ingest_ts
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""

SCORES_SQL = TXN_SQL + ", scored AS (SELECT *, coalesce(txn_amt, 0) / 500000 AS score FROM txn)"
