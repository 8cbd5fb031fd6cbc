from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import split


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 10 == 0, 1).otherwise(0)
    return spark.range(1003).select("id", label.alias("y"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("t")).cache()


def ids(df):
    return {r["id"] for r in df.collect()}


def test_stratified_split_is_exact_and_whole(rows):
    train, test = split.stratified_split(rows, "y", "id", 0.2, 42)
    assert test.count() == 201 and train.count() == 802
    assert test.where("y = 1").count() == 20
    assert ids(train) | ids(test) == ids(rows) and not ids(train) & ids(test)


def test_split_does_not_depend_on_partitioning(rows):
    first = ids(split.stratified_split(rows, "y", "id", 0.2, 42)[1])
    assert first == ids(split.stratified_split(rows.repartition(13), "y", "id", 0.2, 42)[1])
    assert first != ids(split.stratified_split(rows, "y", "id", 0.2, 43)[1])


def test_unstratified_when_a_class_is_too_small(spark):
    df = spark.range(10).select("id", (F.col("id") == 0).cast("int").alias("y"))
    train, test = split.stratified_split(df, "y", "id", 0.2)
    assert (train.count(), test.count()) == (8, 2)


def test_many_classes(spark):
    df = spark.range(600).select("id", (F.col("id") % 60).alias("y"))
    flagged = split.with_test_flag(df, "y", "id", 0.3)
    assert {r["n"] for r in flagged.where("piece = 0").groupBy("y").agg(F.count("id").alias("n")).collect()} == {3}


def test_quotas_add_up():
    found = split.quotas({0: 966, 1: 34}, 201)
    assert sum(found.values()) == 201 and found == {0: 194, 1: 7}


def test_folds(rows):
    dealt = split.assign_folds(rows, "y", "id", 4)
    for label in (0, 1):
        sizes = [r["n"] for r in dealt.where(F.col("y") == label).groupBy("fold").agg(F.count("id").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert split.fold_count({0: 9, 1: 3}, 5) == 3
    with pytest.raises(ValueError):
        split.fold_count({0: 9, 1: 1}, 2)
    with pytest.raises(ValueError):
        split.fold_count({0: 9}, 2)


def test_table_of_classes_agrees_with_the_list(spark, monkeypatch):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 13).alias("y"))
    flags = lambda: {r["id"]: r["piece"] for r in split.with_test_flag(df, "y", "id", 0.23).collect()}
    folds = lambda: {r["id"]: r["fold"] for r in split.assign_folds(df, "y", "id", 3).collect()}
    listed = flags(), folds()
    monkeypatch.setattr(split, "LISTED_CLASSES", 3)
    assert (flags(), folds()) == listed


def test_split_of_20000_classes(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 20_000).alias("y"))
    train, test = split.stratified_split(df, "y", "id", 0.25)
    assert test.count() == 15_000 and train.count() == 45_000 and train.select("y").distinct().count() == 20_000
    folded = split.assign_folds(df, "y", "id", 3).groupBy("y", "fold").agg(F.count("id").alias("n"))
    assert folded.count() == 60_000 and folded.where("n <> 1").isEmpty()


def test_not_a_class_label(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_CLASSES", 5)
    with pytest.raises(ValueError):
        split.class_sizes(spark.range(10), "id")


def test_temporal_split_with_a_hot_time(rows):
    early, late = split.temporal_split(rows, "t", "id", 0.3)
    assert early.count() == 300 and late.count() == 703
    order = sorted((r["t"], r["id"]) for r in rows.collect())
    assert ids(early) == {i for _, i in order[:300]}


def test_slices(rows):
    found = split.monitoring_slices(rows, "id", 100)
    assert {r["slice"]: r["n"] for r in found.groupBy("slice").agg(F.count("id").alias("n")).collect()} == {"reference": 100, "current": 100}
    assert ids(found) == ids(split.monitoring_slices(rows.repartition(5), "id", 100))
    assert split.monitoring_slices(rows, "id", 10_000).count() == 1003
    with pytest.raises(ValueError):
        split.monitoring_slices(rows.limit(1), "id", 10)


def test_nth_record(rows):
    assert split.nth_record(rows, "id", 5, ["y"]).first()["record"] == '{"id":5,"t":5}'
    with pytest.raises(ValueError):
        split.nth_record(rows, "id", -1)
    with pytest.raises(ValueError):
        split.nth_record(rows, "id", 1003)


def test_best_run_and_ranks(spark):
    runs = spark.createDataFrame([("a", 0.5, "FINISHED"), ("b", 0.9, "FAILED"), ("c", None, "FINISHED"), ("d", 0.7, "FINISHED")], "run_id string, f1 double, status string")
    assert split.best_run(runs, "f1").first()["run_id"] == "d"
    assert [r["run_id"] for r in split.comparison(runs, "f1").collect()] == ["b", "d", "a", "c"]
    scores = spark.createDataFrame([("p", 0.5), ("q", 0.9), ("r", 0.9), ("s", 0.1)], "params string, m double")
    assert {r["params"]: r["rank"] for r in split.ranked_scores(scores, "m").collect()} == {"q": 1, "r": 1, "p": 3, "s": 4}
