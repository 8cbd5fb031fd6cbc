"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exactdedup import exact_groups
from .importance import resample, resample_sql
from .katz import score_sql, score_texts
from .langid import identify
from .mixing import mix_documents, mixing_sql
from .neardup import near_groups
from .pieces import encode
from .repair import repair, repair_sql
from .repeats import remove_repeats
from .shards import assign_shards
from .tokencount import count_tokens
from .topk import top_k
from .toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_mixing_weights", mixing_sql())
def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("probability", "weight")})


@query("op3_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


@query("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS n, count(*) OVER (PARTITION BY h) AS group_size,
  first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, h AS text_sha256 FROM r""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op7_histogram_sort_shards")
def histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


@query("op8_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup", r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT d, unnest(range(1, len(words) - 33)) AS i, words FROM w),
g AS (SELECT d, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS h FROM p),
c AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
hit AS (SELECT d, i FROM g WHERE h IN (SELECT h FROM c)),
gone AS (SELECT DISTINCT d, unnest(range(i, i + 35)) AS i FROM hit),
k AS (SELECT d, i, words[i] AS word FROM (SELECT d, words, unnest(range(1, len(words) + 1)) AS i FROM w) ANTI JOIN gone USING (d, i)),
s AS (SELECT d, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (d)""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35, written=True)


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op11_importance_resampling", resample_sql())
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_conversation_repair", repair_sql())
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


@query("op13_katz_lm_score", score_sql())
def katz_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), written=True)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
