"""Temporal, stratified and sampled splits with exact counts.

Membership follows a hash of the row key and a seed, so it is the same on
every run, for every partitioning and after a lost executor. Exact counts come
from cutting the hash range: hashes are evenly spread, so counting them in
2^20 buckets locates each cut to one bucket, and only that bucket's rows are
looked at again. No row is ever numbered and nothing is sorted whole.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import seeded_hash
from ..session import materialize
from .ordered import cut_at

BUCKET_BITS = 20
# A learner's classes are held on the driver; more values than this are no class label to a learner.
MAX_CLASSES = 10_000
# Splits of more classes than this keep sizes, quotas and cuts as tables.
LISTED_CLASSES = 50


def temporal_split(df: DataFrame, time: str, key: str, share: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * share)`` rows by time (ties by key), and the rest."""
    early = cut_at(df, [time, key], int(df.count() * share))
    return df.where(early), df.where(~early)


def listed_sizes(df: DataFrame, target: str) -> dict[Any, int] | None:
    """Rows per class if there are at most ``LISTED_CLASSES``, else None."""
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).limit(LISTED_CLASSES + 1).collect()
    return {r[target]: r["n"] for r in rows} if len(rows) <= LISTED_CLASSES else None


def class_sizes(df: DataFrame, target: str) -> dict[Any, int]:
    """Rows per class (NULL is a class); refuses a target that is no class label."""
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} values: not a class label")
    return {r[target]: r["n"] for r in rows}


def can_stratify(sizes: Mapping[Any, int]) -> bool:
    return len(sizes) >= 2 and min(sizes.values()) >= 2


def quotas(sizes: Mapping[Any, int], total: int) -> dict[Any, int]:
    """Share out ``total`` rows over classes in proportion, by largest remainder."""
    rows = sum(sizes.values())
    exact = {c: total * n / rows for c, n in sizes.items()}
    out = {c: math.floor(e) for c, e in exact.items()}
    rest = total - sum(out.values())
    for c in sorted(sizes, key=lambda c: (out[c] - exact[c], str(c)))[:rest]:
        out[c] += 1
    return out


def hash_cuts(
    df: DataFrame, key: str, seed: int, ranks: Mapping[Any, Sequence[int]], target: str | None = None
) -> dict[Any, list[int | None]]:
    """Largest hash among the first ``r`` rows of a class, for each wanted ``r``.

    None stands for r = 0. Rows with an equal key stay together.
    """
    spark = df.sparkSession
    label = F.col(target) if target else F.lit(None).cast("int")
    hashed = df.select(label.alias("_class"), seeded_hash(seed, key).alias("_h"))
    hashed = hashed.withColumn("_bucket", F.shiftright("_h", 64 - BUCKET_BITS))
    dtype = hashed.schema["_class"].dataType.simpleString()
    wanted = spark.createDataFrame(
        [(c, i, int(r)) for c, rs in ranks.items() for i, r in enumerate(rs) if r > 0],
        f"_class {dtype}, _cut int, _rank bigint",
    )
    out: dict[Any, list[int | None]] = {c: [None] * len(rs) for c, rs in ranks.items()}
    # At most 2^20 buckets per class and window.
    upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = hashed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    buckets = buckets.withColumn("_cum", F.sum("_n").over(upto))
    w = F.broadcast(wanted)
    hit = buckets.join(
        w,
        buckets["_class"].eqNullSafe(w["_class"])
        & (w["_rank"] <= buckets["_cum"]) & (w["_rank"] > buckets["_cum"] - buckets["_n"]),
    ).select(w["_class"], "_cut", "_bucket", (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_left"))
    found = hit.collect()  # one row per cut
    if not found:
        return out
    target_buckets = F.broadcast(
        spark.createDataFrame(
            [(r["_class"], r["_bucket"], r["_cut"], r["_left"]) for r in found],
            f"_class {dtype}, _bucket bigint, _cut int, _left bigint",
        )
    )
    same = hashed["_class"].eqNullSafe(target_buckets["_class"]) & (hashed["_bucket"] == target_buckets["_bucket"])
    inside = hashed.join(target_buckets, same).select(target_buckets["_class"], "_cut", "_left", "_h")
    counted = inside.groupBy("_class", "_cut", "_left", "_h").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_class", "_cut").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        counted.withColumn("_cum", F.sum("_n").over(order))
        .where(F.col("_cum") >= F.col("_left"))
        .groupBy("_class", "_cut")
        .agg(F.min("_h").alias("_h"))
    )
    for r in cuts.collect():
        out[r["_class"]][r["_cut"]] = r["_h"]
    return out


def _piece(df: DataFrame, key: str, seed: int, cuts: Mapping[Any, Sequence[int | None]], target: str | None) -> Column:
    """Index of the piece a row falls into: how many cuts lie below its hash."""
    h = seeded_hash(seed, key)

    def index(values: Sequence[int | None]) -> Column:
        terms = [F.lit(1) if v is None else (h > F.lit(v)).cast("int") for v in values]
        total = F.lit(0)
        for term in terms:
            total = total + term
        return total

    if target is None:
        return index(next(iter(cuts.values())))
    piece = F.lit(0)
    for c, values in cuts.items():
        same = F.col(target).isNull() if c is None else F.col(target) == F.lit(c)
        piece = F.when(same, index(values)).otherwise(piece)
    return piece


def assign_pieces(
    df: DataFrame, key: str, sizes: Mapping[Any, Sequence[int]], seed: int, target: str | None = None, name: str = "piece"
) -> DataFrame:
    """Deal rows of each class into pieces of the given sizes; the last takes the rest."""
    ranks = {}
    for c, parts in sizes.items():
        total, ends = 0, []
        for part in parts:
            total += part
            ends.append(total)
        ranks[c] = ends
    if target is not None and len(sizes) > LISTED_CLASSES:
        dtype = df.schema[target].dataType.simpleString()
        ends = df.sparkSession.createDataFrame(list(ranks.items()), f"_class {dtype}, _ends array<bigint>")
        return deal_by_table(df, key, ends, seed, target, name)
    return df.withColumn(name, _piece(df, key, seed, hash_cuts(df, key, seed, ranks, target), target))


def class_table(df: DataFrame, target: str) -> DataFrame:
    """``_class, _n``, written: for any number of classes."""
    return materialize(df.groupBy(F.col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))


def quota_table(sizes: DataFrame, rows: int, total: int) -> DataFrame:
    """``_class, _q``: the shares of ``quotas`` for any number of classes, in whole numbers."""
    product = f"CAST({total} AS DECIMAL(19, 0)) * CAST(_n AS DECIMAL(19, 0))"
    parts = materialize(
        sizes.select(
            "_class", F.expr(f"({product}) div CAST({rows} AS DECIMAL(19, 0))").cast("long").alias("_q"),
            (-F.expr(f"({product}) % CAST({rows} AS DECIMAL(19, 0))").cast("long")).alias("_left"),
            F.coalesce(F.col("_class").cast("string"), F.lit("None")).alias("_text"),
        )
    )
    rest = total - parts.agg(F.sum("_q")).first()[0]
    return parts.select("_class", (F.col("_q") + cut_at(parts, ["_left", "_text"], rest).cast("long")).alias("_q"))


def deal_by_table(df: DataFrame, key: str, ends: DataFrame, seed: int, target: str, name: str = "piece") -> DataFrame:
    """``assign_pieces`` over a table ``_class, _ends`` (rows of the class before each cut): nothing of it on the driver."""
    h = seeded_hash(seed, key)
    hashed = df.select(F.col(target).alias("_class"), h.alias("_h")).withColumn("_bucket", F.shiftright("_h", 64 - BUCKET_BITS))
    upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = hashed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(upto))
    wanted = ends.select(F.col("_class").alias("_c"), F.posexplode("_ends").alias("_cut", "_rank"))
    within = (F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("_n"))
    hit = materialize(
        buckets.join(wanted, F.col("_class").eqNullSafe(F.col("_c")) & within)
        .select("_c", "_cut", F.col("_bucket").alias("_b"), (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_left"))
    )
    inside = hashed.join(hit, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    order = Window.partitionBy("_c", "_cut").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = inside.groupBy("_c", "_cut", "_left", "_h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(order))
    cuts = counted.where("_cum >= _left").groupBy("_c", "_cut").agg(F.min("_h").alias("_h"))
    known = cuts.groupBy("_c").agg(F.collect_list("_h").alias("_cuts"))  # one value a piece
    none = ends.select("_class", F.size(F.filter("_ends", lambda r: r <= 0)).alias("_none"))
    table = materialize(none.join(known, F.col("_class").eqNullSafe(F.col("_c")), "left").select("_class", "_none", F.coalesce("_cuts", F.array().cast("array<bigint>")).alias("_cuts")))
    joined = df.join(table, df[target].eqNullSafe(table["_class"]), "left")
    piece = F.col("_none") + F.size(F.filter("_cuts", lambda v: v < h))
    return joined.select(*[df[c] for c in df.columns], piece.alias(name))


def stratified_split(
    df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exact class quotas; unstratified when a class is too small."""
    labelled = with_test_flag(df, target, key, test_size, seed)
    return labelled.where("piece = 1").drop("piece"), labelled.where("piece = 0").drop("piece")


def with_test_flag(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``piece`` 0 marks test rows, 1 training rows."""
    sizes = listed_sizes(df, target)
    if sizes is None:
        found = class_table(df, target)
        rows, least = found.agg(F.sum("_n"), F.min("_n")).first()
        test_rows = math.ceil(rows * test_size)
        if least >= 2:
            ends = quota_table(found, rows, test_rows).select("_class", F.array("_q").alias("_ends"))
            return deal_by_table(df, key, ends, seed, target)
        return assign_pieces(df, key, {None: [test_rows]}, seed)
    rows = sum(sizes.values())
    test_rows = math.ceil(rows * test_size)
    if not can_stratify(sizes):
        return assign_pieces(df, key, {None: [test_rows]}, seed)
    return assign_pieces(df, key, {c: [q] for c, q in quotas(sizes, test_rows).items()}, seed, target)


def fold_count(sizes: Mapping[Any, int], requested: int) -> int:
    if not can_stratify(sizes):
        raise ValueError("cross-validation needs two classes of at least two rows each")
    return min(int(requested), min(sizes.values()))


def assign_folds(df: DataFrame, target: str, key: str, folds: int = 2, seed: int = 42) -> DataFrame:
    """Add ``fold``; class sizes of any two folds differ by at most one row."""
    sizes = listed_sizes(df, target)
    if sizes is None:
        found = class_table(df, target)
        least = found.agg(F.min("_n")).first()[0]
        k = fold_count({0: least, 1: least}, folds)
        before = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: i * F.expr(f"_n div {k}") + F.least(i.cast("long"), F.col("_n") % k))
        return deal_by_table(df, key, found.select("_class", (before if k > 1 else F.array().cast("array<bigint>")).alias("_ends")), seed, target, "fold")
    k = fold_count(sizes, folds)
    parts = {c: [n // k + (1 if i < n % k else 0) for i in range(k - 1)] for c, n in sizes.items()}
    return assign_pieces(df, key, parts, seed, target, "fold")


def monitoring_slices(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A seeded sample of ``min(n, max(2, 2 * size))`` rows, halved by ``slice``."""
    rows = df.count()
    if rows < 2:
        raise ValueError("monitoring needs at least two rows")
    needed = min(rows, max(2, size * 2))
    half = max(1, needed // 2)
    dealt = assign_pieces(df, key, {None: [half, needed - half]}, seed)
    name = F.when(F.col("piece") == 0, "reference").otherwise("current")
    return dealt.where("piece < 2").select(*df.columns, name.alias("slice"))


def nth_record(df: DataFrame, key: str, position: int, drop: Sequence[str] = ()) -> DataFrame:
    """The record at a position by key, as JSON with sorted fields."""
    if position < 0:
        raise ValueError("the position must be zero or more")
    before = cut_at(df, [key], position)
    fields = sorted(c for c in df.columns if c not in drop)
    row = df.where(~before).orderBy(key).limit(1)
    found = row.select(
        F.col(key).alias("row_key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record")
    )
    if found.isEmpty():
        raise ValueError(f"there is no record at position {position}")
    return found


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    """The finished run with the highest metric."""
    return runs.where(F.col("status") == "FINISHED").orderBy(F.desc_nulls_last(metric), "run_id").limit(1)


def comparison(runs: DataFrame, metric: str) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last(metric))


def ranked_scores(scores: DataFrame, by: str) -> DataFrame:
    """Rank of parameter sets by mean score; ties share a rank. A few hundred rows."""
    return scores.select("*", F.rank().over(Window.orderBy(F.desc(by))).cast("int").alias("rank"))
