"""Exact order statistics: the distributed way equals the small way and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.ordered import cut_at, exact_quantiles, group_quantiles, running_totals

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key and one value hold a third of the rows; some keys and values are NULL."""
    rng = np.random.default_rng(7)
    n = 3000
    keys = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    values = np.where(rng.random(n) < 0.34, 5.0, rng.lognormal(3, 2, n).round(2))
    rows = [
        (None if i % 97 == 0 else str(k), None if i % 53 == 0 else float(v), i)
        for i, (k, v) in enumerate(zip(keys, values))
    ]
    return spark.createDataFrame(rows, "k string, v double, id bigint").cache()


def pdf(df):
    return df.toPandas()


@pytest.mark.parametrize("task_rows", [10**6, 0])
def test_exact_quantiles(skewed, task_rows):
    found = exact_quantiles(skewed, ["v", "id"], PROBS, task_rows=task_rows, accuracy=500)
    data = pdf(skewed)
    for c in ("v", "id"):
        assert np.allclose(found[c], np.quantile(data[c].dropna(), PROBS))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(empty, ["v"], [0.5])["v"] == [None]
    assert exact_quantiles(empty, ["v"], [0.5], task_rows=-1)["v"] == [None]


@pytest.mark.parametrize("task_rows", [10**6, 0])
def test_group_quantiles(skewed, task_rows):
    found = {r["k"]: r for r in group_quantiles(skewed, ["k"], "v", PROBS, task_rows).collect()}
    data = pdf(skewed).dropna(subset=["v"])
    assert len(found) == 6
    for key, part in data.groupby("k", dropna=False):
        row = found[None if key != key or key is None else key]
        assert row["n"] == len(part)
        assert np.allclose(row["quantiles"], np.quantile(part["v"], PROBS))


def test_group_quantiles_on_both_sides_of_the_bound(spark, monkeypatch):
    """Large groups by brackets, small ones directly; only the values around the ranks are written."""
    from millrace.operators import ordered

    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.normal(size=20_000)] + [(None, float(v)) for v in rng.integers(0, 50, 9_000)]
    rows += [(f"k{i % 300}", float(v)) for i, v in enumerate(rng.random(3_000))] + [("hot", None)] * 50
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    written = []
    count = ordered.materialize_counted
    monkeypatch.setattr(ordered, "materialize_counted", lambda d: written.append(out := count(d)) or out)
    found = {r["k"]: r for r in group_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9], task_rows=5_000).collect()}
    data = df.toPandas().dropna(subset=["v"])
    for key, part in data.groupby("k", dropna=False):
        row = found[None if key != key or key is None else key]
        assert row["n"] == len(part) and np.allclose(row["quantiles"], np.quantile(part["v"], [0.1, 0.5, 0.9]), rtol=1e-12)
    assert len(found) == 302 and max(n for _, n in written) < 5_000


def test_a_missed_bracket_is_opened(skewed, monkeypatch):
    """A sketch that says the same value for every rank."""
    from millrace.operators import ordered

    wrong = lambda c, points, accuracy: F.array(*[F.first(c)] * len(points))
    monkeypatch.setattr(ordered.F, "percentile_approx", wrong)
    data = pdf(skewed)
    assert np.allclose(exact_quantiles(skewed, ["v"], PROBS, task_rows=0)["v"], np.quantile(data["v"].dropna(), PROBS))
    for r in group_quantiles(skewed, ["k"], "v", [0.25, 0.5], task_rows=0).collect():
        part = data[data["k"].isna() if r["k"] is None else data["k"] == r["k"]]["v"].dropna()
        assert np.allclose(r["quantiles"], np.quantile(part, [0.25, 0.5]))


def test_keyless_group_quantiles(skewed):
    for task_rows in (10**6, 0):
        row = group_quantiles(skewed, [], "v", [0.5], task_rows).first()
        assert row["quantiles"][0] == pytest.approx(pdf(skewed)["v"].median())


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("task_rows", [10**6, 0])
def test_running_totals(skewed, descending, task_rows):
    counts = skewed.where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    found = running_totals(counts, ["k"], "v", ["n"], descending, task_rows).toPandas()
    assert len(found) == counts.count()
    for _, part in found.groupby("k", dropna=False):
        part = part.sort_values("v", ascending=not descending)
        assert (part["n"].cumsum().to_numpy() == part["cum_n"].to_numpy()).all()


def test_running_totals_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.lit(2).alias("n"))
        found = running_totals(counts, ["k"], "v", ["n"], task_rows=0).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for k, part in found.groupby("k"):
        part = part.sort_values("v")
        assert (part["cum_n"].to_numpy() == 2 * np.arange(1, len(part) + 1)).all()


@pytest.mark.parametrize("rank", [0, 1, 700, 1500, 2999, 3000, 5000])
def test_cut_at_takes_exactly_the_first_rows(skewed, rank):
    early = skewed.where(cut_at(skewed, ["v", "id"], rank))
    late = skewed.where(~cut_at(skewed, ["v", "id"], rank))
    assert early.count() == min(rank, 3000)
    assert early.count() + late.count() == 3000
    order = pdf(skewed).sort_values(["v", "id"], na_position="last")["id"].head(rank)
    assert set(pdf(early)["id"]) == set(order)


@pytest.mark.parametrize("column", ["n", "t", "ts", "x"])
@pytest.mark.parametrize("rank", [1, 40, 1234, 2999, 3600, 3990, 4000])
def test_cut_at_narrows_brackets_of_any_type(spark, monkeypatch, column, rank):
    """Numbers, text, timestamps and doubles with NaN, a third of the rows one value and some NULL; nothing above the bound is sorted."""
    from millrace.operators import ordered

    rows = spark.range(4000).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1500)))
    n = F.when(F.col("id") % 3 == 0, F.lit(700)).when(F.col("id") % 10 != 1, F.col("h"))
    rows = rows.select("id", n.cast("int").alias("n"), F.concat(F.lit("ü"), n.cast("string")).alias("t"), F.timestamp_seconds(n * 60).alias("ts"), F.when(F.col("h") % 50 == 1, F.lit(float("nan"))).otherwise(n / 7).alias("x")).repartition(4).cache()
    summed = []
    totals = ordered.running_totals
    monkeypatch.setattr(ordered, "running_totals", lambda d, *a, **how: summed.append(d.count()) or totals(d, *a, **how))
    first = rows.where(cut_at(rows, [column, "id"], rank, task_rows=200))
    order = rows.orderBy(F.col(column).asc_nulls_last(), "id").limit(rank)
    assert sorted(r["id"] for r in first.collect()) == sorted(r["id"] for r in order.collect())
    assert max(summed, default=0) <= 200


def test_running_totals_have_a_partition_for_every_task_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("x"), F.lit(1).alias("n"))
    summed = running_totals(df, [], "x", ["n"], task_rows=250)
    assert summed.agg(F.max("cum_n")).first()[0] == 5000
    wide = df.repartitionByRange(-(-5000 // 250), "x").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert wide <= 2 * 250


def test_no_bins_without_values(spark):
    from millrace.operators.profile import rate_by_quantile_bin

    empty = spark.createDataFrame([(None, 1), (None, 0)], "x double, y int")
    assert rate_by_quantile_bin(empty, "x", "y").count() == 0


def test_quantiles_of_many_columns(spark):
    """Forty projected columns: a condition on all of them at once took the optimizer's memory."""
    rows = spark.range(400).select(*[F.when(F.col("id") % (i + 3) != 0, (F.col("id") * (i + 1)) % 101).alias(f"c{i}") for i in range(40)])
    found = exact_quantiles(rows, rows.columns, [0.25, 0.5], task_rows=400)
    values = rows.toPandas()
    for c in rows.columns:
        assert found[c] == pytest.approx(list(values[c].astype(float).quantile([0.25, 0.5])))


def test_quantiles_with_nan(spark):
    """NaN is above all numbers, for one bracket and for several that meet there."""
    rows = spark.createDataFrame([(float(i),) if i < 60 else (float("nan"),) for i in range(100)], "v double")
    low, high, top = exact_quantiles(rows, ["v"], [0.1, 0.9, 1.0], task_rows=5, accuracy=100)["v"]
    assert low == pytest.approx(9.9) and np.isnan(high) and np.isnan(top)
