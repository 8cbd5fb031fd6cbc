from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators.profile import profile
from millrace.operators.quality import Issue, issues_frame, metrics_frame
from millrace.sources import tables


@pytest.fixture()
def small(spark):
    return spark.createDataFrame([(1, "a", 2.5), (2, None, None), (3, "c", 0.5)], "id bigint, name string, x double")


@pytest.mark.parametrize("suffix", [".csv", ".parquet", ".pq", ".jsonl"])
def test_round_trip(spark, small, tmp_path, suffix):
    path = tables.write_table(small, str(tmp_path / f"t{suffix}"))
    back = tables.read_table(spark, path, schema=small.schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, small.collect()), key=repr)


def test_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.read_table(spark, str(tmp_path / "d.json")).count() == 2


def test_csv_texts_without_value(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\nNA,1\nnull,nan\nx,3\n")
    rows = tables.read_table(spark, str(tmp_path / "n.csv"), schema="a string, b double").collect()
    assert [r["a"] for r in rows] == [None, None, "x"]


def test_errors(spark, tmp_path):
    with pytest.raises(tables.TableNotFound):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "t.xlsx").write_text("x")
    with pytest.raises(tables.UnsupportedFormat):
        tables.read_table(spark, str(tmp_path / "t.xlsx"))
    (tmp_path / "broken.parquet").write_text("no parquet")
    with pytest.raises(tables.UnreadableTable):
        tables.read_table(spark, str(tmp_path / "broken.parquet"))
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(tables.EmptyTable):
        tables.read_table(spark, str(tmp_path / "empty.csv"))
    assert tables.read_table(spark, str(tmp_path / "empty.csv"), allow_empty=True).count() == 0


@pytest.mark.parametrize(("value", "limit"), [(None, None), ("null", None), (0, None), (-3, None), ("7", 7)])
def test_row_limit(value, limit):
    assert tables.row_limit(value) == limit


def test_load_joined(spark, tmp_path):
    fact = spark.createDataFrame([(2, 0, 5.0), (1, 1, 9.0)], "TransactionID bigint, isFraud int, TransactionAmt double")
    side = spark.createDataFrame([(1, "mobile")], "TransactionID bigint, DeviceType string")
    tables.write_table(fact, str(tmp_path / "f.parquet"))
    tables.write_table(side, str(tmp_path / "s.parquet"))
    joined = tables.load_joined(spark, str(tmp_path / "f.parquet"), str(tmp_path / "s.parquet"), "TransactionID")
    assert {r["TransactionID"]: r["DeviceType"] for r in joined.collect()} == {1: "mobile", 2: None}
    alone = tables.load_joined(spark, str(tmp_path / "f.parquet"), str(tmp_path / "no.parquet"), "TransactionID", limit=1)
    assert [r["TransactionID"] for r in alone.collect()] == [1] and "DeviceType" not in alone.columns


def test_findings_are_written(spark, tmp_path):
    issues = issues_frame(spark, [Issue("nulls", "error", "too many", "x", {"n": 3})])
    metrics = metrics_frame(spark, {"quality": {"missing_values": {"n": 1}}})
    tables.save_findings(issues, metrics, str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r/issues")).first()
    assert back["check"] == "nulls" and back["details"]["n"] == "3"
    assert spark.read.json(str(tmp_path / "r/metrics")).count() == 1


def test_profile_policy(spark, small, tmp_path):
    path = str(tmp_path / "profile")
    build = lambda d: profile(d, ["x"], ["name"], "id")
    assert tables.load_or_refresh_profile(spark, path, build, small, create_if_missing=False) is None
    made = tables.load_or_refresh_profile(spark, path, build, small)
    assert made["numeric"].first()["count"] == 2
    roles = {r["column"]: r["role"] for r in made["categorical"].collect()}
    assert roles == {"name": "feature", "id": "target"}
    more = small.union(small)
    assert tables.load_or_refresh_profile(spark, path, build, more)["numeric"].first()["count"] == 2
    assert tables.load_or_refresh_profile(spark, path, build, small, more, update=True)["numeric"].first()["count"] == 4


def test_scan_reads_only_what_is_asked(spark, small, tmp_path):
    path = tables.write_table(small, str(tmp_path / "p.parquet"))
    plan = tables.read_table(spark, path).where(F.col("id") > 1).select("x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan and "name" not in plan.split("ReadSchema")[1]


def test_many_first_rows(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") % 10 != 0, (F.col("id") / 4).cast("int")).alias("k"), "id")
    few = sorted(str(r["k"]) for r in tables.bounded_scan(df, 1001, "k").collect())
    nulls = tables.bounded_scan(df, 2900, "k").count()
    monkeypatch.setattr(tables, "TOP_ROWS", 10)
    assert sorted(str(r["k"]) for r in tables.bounded_scan(df, 1001, "k").collect()) == few and len(few) == 1001
    assert tables.bounded_scan(df, 2900, "k").count() == nulls == 2900


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    """A write that fails midway, and a run that ended between the two moves, leave the old table; a table may be written over itself."""
    folder = tmp_path / "shelf"
    path = str(folder / "t.parquet")
    tables.write_table(spark.range(5), path)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.write_table(broken, path)
    assert tables.read_table(spark, path).count() == 5 and [f.name for f in folder.iterdir() if not f.name.startswith(".")] == ["t.parquet"]
    tables.write_table(tables.read_table(spark, path).where("id > 1"), path)
    assert sorted(r["id"] for r in tables.read_table(spark, path).collect()) == [2, 3, 4]
    (folder / "t.parquet").rename(folder / "t.parquet.old-1")  # as if the run had ended here
    assert tables.path_exists(spark, path) and tables.read_table(spark, path).count() == 3


def test_findings_and_profiles_are_replaced_as_a_whole(spark, tmp_path):
    profile = {p: spark.range(2).withColumn("part", F.lit(p)) for p in ("columns", "numeric", "categorical", "distribution")}
    path = str(tmp_path / "profile")
    tables.save_profile(profile, path)
    bad = {**profile, "distribution": spark.range(1).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="lost"):
        tables.save_profile({p: d.union(d) if p != "distribution" else d for p, d in bad.items()}, path)
    assert {p: d.count() for p, d in tables.load_profile(spark, path).items()} == dict.fromkeys(profile, 2)
    issues, metrics = spark.createDataFrame([("a", 1)], "check string, n int"), spark.createDataFrame([("m", 2)], "metric string, n int")
    for _ in range(2):
        tables.save_findings(issues, metrics, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "issues")).count() == 1 and sorted(f.name for f in (tmp_path / "report").iterdir()) == ["issues", "metrics"]
