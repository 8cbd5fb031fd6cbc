"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each cell (source, language, topic) get one factor per margin; in turn, each margin's factors are set so that its weighted
tokens equal its target shares. Documents are then sampled with a probability that follows their cell's factors.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import free_name

MARGINS = ("source", "lang", "topic")
# What a text of each topic contains; the first that fits holds, any other text is prose.
TOPICS = (
    ("legal", "[Ll]icen[cs]e|[Cc]opyright|LICENSE|COPYRIGHT"),
    ("contact", "[A-Za-z0-9._-]@[A-Za-z0-9-]+[.][a-z]"),
    ("tabular", " [|] "),
    ("numeric", "[0-9]{4}"),
)
# The power of its tokens that a margin's value gets as its share, unless targets are given.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 8


def topic_of(text: Column, rules: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(key: str) -> Column:
    """A number in [0, 1) from an id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share): each value's share of the margin, proportional to its tokens raised to a power."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), power).alias("weight"))
    whole = sums.agg(F.sum("weight")).first()[0] or 1.0
    return sums.select("value", (F.col("weight") / whole).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """The written cells with ``factor``: weighted tokens meet the target shares of all margins, the last one exactly.

    ``targets`` has (value, share) per margin; values without a target, or without tokens, keep their factor. Every step is an
    aggregation over cells and a join of its sums, so cells and margins may be as many as the data have.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now, last = cells.withColumn("factor", F.lit(1.0)), None
    for _ in range(rounds):
        for margin, share in targets.items():
            sums = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("factor")).alias("got"))
            change = sums.join(share, F.col(margin) == F.col("value"), "left").select(
                margin, F.coalesce(F.when(F.col("got") > 0, F.col("share") * float(total) / F.col("got")), F.lit(1.0)).alias("change")
            )
            now = now.join(change, margin).withColumn("factor", F.col("factor") * F.col("change")).select(*cells.columns, "factor")
        now = scratch.save(now)
        if last is not None:
            scratch.free(last)
        last = now
    return now


def _described(docs: DataFrame, text: str, names: Mapping[str, str]) -> dict[str, Column]:
    blank = F.lit("")
    return {"source": F.coalesce(F.col(names["source"]).cast("string"), blank), "lang": F.coalesce(F.col(names["lang"]).cast("string"), blank), "topic": topic_of(F.coalesce(F.col(text), blank))}


def _fit(rows: DataFrame, scratch: Scratch, targets: Mapping[str, DataFrame] | None, keep: float, rounds: int) -> DataFrame:
    """Cells with weight and probability, from written rows of the margins and n_tokens."""
    cells = scratch.save(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    shares = targets or {m: scratch.save(tempered(cells, m, TEMPER[m])) for m in MARGINS}
    probability = F.least(F.lit(1.0), F.col("factor") * keep)
    return rake(cells, shares, scratch, rounds).select(*MARGINS, probability.alias("probability"), (F.col("factor") / probability).alias("weight"))


def mix_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping[str, DataFrame] | None = None, keep: float = 1.0, rounds: int = ROUNDS
) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, probability, weight, kept.

    A row is kept when a hash of its id, as a number in [0, 1), is under min(1, keep * factor of its cell); ``weight`` is what a kept row still
    stands for, 1 / keep or more. Null sources and languages form the value ''; null texts are prose without tokens; equal ids share their
    fate within a cell; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    parts = _described(docs, text, {"source": source, "lang": lang})
    rows = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in parts.items()], token_count(F.col(text)).alias("n_tokens")))
    fitted = _fit(rows, scratch, targets, keep, rounds)
    return rows.join(fitted, list(MARGINS)).select("doc_id", *MARGINS, "n_tokens", "probability", "weight", (unit_hash("doc_id") < F.col("probability")).alias("kept"))


def sample_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping[str, DataFrame] | None = None, keep: float = 1.0, rounds: int = ROUNDS
) -> DataFrame:
    """The rows that ``mix_documents`` keeps, with all their columns. Texts are read twice and not shuffled while the cells are few enough to be sent
    to all by the size Spark measures."""
    scratch = Scratch(docs.sparkSession)
    parts = _described(docs, text, {"source": source, "lang": lang})
    rows = scratch.save(docs.select(*[c.alias(n) for n, c in parts.items()], token_count(F.col(text)).alias("n_tokens")))
    fitted = _fit(rows, scratch, targets, keep, rounds)
    names = {c: free_name(docs, f"cell_{c}") for c in (*MARGINS, "probability")}
    cells = fitted.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = [parts[m] == F.col(names[m]) for m in MARGINS]
    return docs.join(cells, same[0] & same[1] & same[2]).where(unit_hash(doc_id) < F.col(names["probability"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_sql(rounds: int = ROUNDS, keep: float = 1.0) -> str:
    """The same in SQL over ``documents``."""
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    steps = [f"""
    d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE 'prose' END AS topic,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
    c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
    total AS (SELECT sum(tokens)::DOUBLE AS n FROM c)"""]
    for m in MARGINS:
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m} AS value, w / sum(w) OVER () AS share FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {TEMPER[m]}) AS w FROM c GROUP BY {m}))")
    before = "(SELECT *, 1.0::DOUBLE AS factor FROM c)"
    for k in range(rounds):
        for m in MARGINS:
            steps.append(
                f"s{k}_{m} AS MATERIALIZED (SELECT source, lang, topic, tokens, factor * CASE WHEN got > 0 THEN share * (SELECT n FROM total) / got ELSE 1.0 END AS factor "
                f"FROM (SELECT *, sum(tokens * factor) OVER (PARTITION BY {m}) AS got FROM {before} b) x JOIN t_{m} ON value = {m})"
            )
            before = f"s{k}_{m}"
    return "WITH " + ",\n".join(steps) + f""",
    f AS (SELECT source, lang, topic, least(1.0, factor * {keep}) AS p, factor FROM {before})
    SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS probability, round(factor / p, 6) AS weight,
      CAST(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8)) AS BIGINT) / 4294967296.0 < p AS kept
    FROM d JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic"""
