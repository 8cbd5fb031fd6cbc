"""Exact top-k search by inner product with a uniform threshold in three phases.

The dimensions are dealt over ``lists``: each list knows one part of every vector and can score that part alone. (1) Every list gives its best
entries for a query; their whole scores make a safe cutoff, the score of the worst of the best so far. (2) The cutoff goes
to all lists, and each returns every entry whose part reaches its even share: a vector with at least the
cutoff in all must reach the share in some list. (3) Entries whose parts are not all known and could still reach the
cutoff are scored exactly.

A list is stored in slices of bounded size, and a query block meets a slice as two matrices. Equal vectors are searched as one, with
their smallest ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .common import pieces_for


def products(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two matrices; exact within 64 bits."""
    width = max(queries.shape[1], 1)
    if float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(entries.astype(float)).max(initial=0)) * width < 2**53:
        return (queries.astype(np.float64) @ entries.astype(np.float64).T).astype(np.int64)
    return queries @ entries.T


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in column], np.int64).reshape(len(column), -1)


def _meet(entries: pd.DataFrame, queries: pd.DataFrame, choose: Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """The chosen (query, entry, list, part of the score) where one slice of a list meets one query block."""
    out = [pd.DataFrame({"q": np.empty(0, np.int64), "e": np.empty(0, np.int64), "list": np.empty(0, np.int32), "part": np.empty(0, np.int64)})]
    if len(entries) and len(queries):
        right = _matrix(entries["v"])
        for at in range(0, len(queries), 256):
            some = queries.iloc[at : at + 256]
            score = products(_matrix(some["v"]), right)
            i, j = choose(score, some)
            out.append(pd.DataFrame({"q": some["q"].to_numpy()[i], "e": entries["e"].to_numpy()[j], "list": np.int32(entries["list"].iloc[0]), "part": score[i, j]}))
    return pd.concat(out, ignore_index=True)


def _best(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    n = min(n, score.shape[1])
    j = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.repeat(np.arange(len(score)), n), j.ravel()


def _reach(score: np.ndarray, queries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    share = queries["share"].fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy()
    return np.nonzero(score >= share[:, None])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", lists: int = 2, slice_rows: int = 8192, query_rows: int = 2048
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k highest integer inner products with all other rows.

    Components count as floor(256 * x). Ties go to the smaller vec_id. Rows whose vector, id or any component is null or not finite
    take no part; vectors of other lengths are not compared; exactly repeated rows count once; a row is
    never its own neighbour, by id. Fewer than k others give them all.
    """
    scratch = Scratch(vectors.sparkSession)
    more = k + 1  # the query itself may be among the best
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), is_query.alias("asks"))
    sound = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = scratch.save(rows.where(sound).select("id", F.transform("x", lambda x: F.floor(x * 256)).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks")))

    by_vector = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id", F.dense_rank().over(by_vector).alias("n")).where(F.col("n") <= more)
    entries = scratch.save(few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.monotonically_increasing_id().alias("e"), "v", "ids"))
    queries = scratch.save(rows.where("asks").select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v"))
    slices, blocks = pieces_for(entries.count(), slice_rows), pieces_for(queries.count(), query_rows)

    def parts(df: DataFrame) -> DataFrame:
        width = F.size("v")
        part = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), lambda b: F.slice("v", F.floor(b * width / lists).cast("int") + 1, (F.floor((b + 1) * width / lists) - F.floor(b * width / lists)).cast("int"))))
        return df.select("*", width.alias("d"), part.alias("list", "part")).drop("v").withColumnRenamed("part", "v")

    entry_parts = parts(entries.select("e", "v", F.pmod(F.xxhash64("e"), F.lit(slices)).alias("slice"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(df: DataFrame) -> DataFrame:
        return parts(df.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def everywhere(asked: DataFrame, choose: Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        key = ["d", "list", "slice", "block"]
        return entry_parts.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda e, q: _meet(e, q, choose), "q long, e long, list int, part long")

    def resolve(pairs: DataFrame) -> DataFrame:
        """(q, e, score) of pairs, from whole vectors."""
        both = pairs.join(entries.select("e", F.col("v").alias("ve")), "e").join(queries.select("q", F.col("v").alias("vq")), "q")
        return both.select("q", "e", F.aggregate(F.zip_with("ve", "vq", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))

    # phase 1: the lists' best, and what they score in all
    by_list = Window.partitionBy("q", "list").orderBy(F.desc("part"), "e")
    local = everywhere(ask(queries), lambda score, _: _best(score, more)).withColumn("n", F.row_number().over(by_list)).where(F.col("n") <= more)
    known = resolve(local.select("q", "e").distinct())
    ranked = known.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "e")))
    cutoff = ranked.where(F.col("n") == more).select("q", F.col("score").alias("cutoff"))
    asked = scratch.save(queries.join(cutoff, "q", "left").withColumn("share", F.ceil(F.col("cutoff") / lists)))
    # phase 2: all that reach an even share of the cutoff in some list
    sent = everywhere(ask(asked), _reach)
    gathered = sent.groupBy("q", "e").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("seen"))
    gathered = scratch.save(gathered.join(asked.select("q", "cutoff", "share"), "q").where(F.col("cutoff").isNull() | (F.col("score") + (lists - F.col("seen")) * (F.col("share") - 1) >= F.col("cutoff"))))
    # phase 3: the scores that are still in part unknown
    scored = gathered.where(F.col("seen") == lists).select("q", "e", "score").unionByName(resolve(gathered.where(F.col("seen") < lists).select("q", "e")))

    least = scored.join(entries.select("e", "ids"), "e")
    best = least.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("n") <= more)
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "v").distinct().join(queries, "v").select("query_id", "q")
    pairs = asking.join(best.select("q", "score", F.explode("ids").alias("vec_id")), "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
