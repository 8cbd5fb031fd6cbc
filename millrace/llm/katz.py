"""Scores of texts under a word bigram model with Katz backoff.

Counts up to ``CUT`` are discounted by Good-Turing; what a context loses that way goes to the words never seen in it, in proportion
to their own (likewise discounted) probabilities, so that every context's probabilities sum to one exactly. A token's probability is found
recursively: seen after its context, the discounted share; otherwise the context's backoff weight times the probability of the word alone, which for
unknown words is what single words lose. Where counts of counts give no discount between 0 and 1, an absolute one
takes its place, and a context that loses nothing gets one event more, so no probability is zero.

Texts stay in groups; words are 64-bit hashes (XXH64). Counts live in tables partitioned by hash: every group sends its
distinct words, then its distinct pairs, once each with their counts, as one compact row an owner; an owner adds them
up and answers every group in the order of its question. Owners of words number them, and pairs travel as such numbers, which take fewer bytes than hashes. A pair goes by its context, so an owner sees all that follows a word; contexts of very many
occurrences are cut over many owners and their sums added up.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import CRC_TABLE_SQL, SPACES, crc32_sql, mix
from .exchange import cuts, packed, read_replies, scaled, unpacked
from .words import Stream

CUT = 5  # counts above are taken as they are
BEGIN, END = np.uint64(0x1F2E3D4C5B6A7988), np.uint64(0x8E7D6C5B4A392817)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(SPACES)] = 32
HOT_CONTEXTS = 65_536


def discounts(n: list[int]) -> np.ndarray:
    """The factors of counts 1 to ``CUT``, from the numbers of items seen 1 to ``CUT + 1`` times."""
    seen = np.array(n, float)
    r = np.arange(1, CUT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (CUT + 1) * seen[CUT] / seen[0]
        turing = ((r + 1) * seen[1:] / (r * seen[:-1]) - common) / (1 - common)
    absolute = 1 - seen[0] / (seen[0] + 2 * max(seen[1], 1)) / r
    return np.where((turing > 0) & (turing < 1), turing, absolute)


class Words:
    """Probabilities of single words: N tokens, V distinct, and the counts of counts."""

    def __init__(self, stats: list[int]) -> None:
        self.tokens, self.distinct = stats[:2]
        self.factor = np.ones(CUT + 2)
        self.factor[1 : CUT + 1] = discounts(stats[2:])
        lost = float(((1 - self.factor[1 : CUT + 1]) * np.arange(1, CUT + 1) * stats[2 : CUT + 2]).sum())
        self.total = self.tokens + (0 if lost > 0 else 1)
        self.unknown = (lost if lost > 0 else 1) / self.total

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.factor[np.minimum(count, CUT + 1)] * count / self.total, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


class Group:
    """The tokens of a group of texts, over its own sorted dictionary of word hashes."""

    def __init__(self, docs: pd.DataFrame) -> None:
        parts = [(t or "").encode() for t in docs["text"]]
        data = _FOLD[np.frombuffer(b"".join(p + b" " for p in parts), np.uint8)]
        inside = np.concatenate(([False], data != 32))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        begin, length = turns[::2], turns[1::2] - turns[::2]
        ends = np.cumsum([len(p) + 1 for p in parts])
        words = np.diff(np.searchsorted(begin, ends), prepend=0)
        self.size = words + 1  # with the end
        stop = np.cumsum(self.size) - 1
        hashes = np.insert(Stream(data).hashes(begin, length), np.cumsum(words), END)
        self.ids, token = np.unique(np.append(hashes, BEGIN), return_inverse=True)
        self.token = token[:-1].astype(np.int32)
        del data, inside, hashes, token
        before = np.concatenate((self.token[-1:], self.token[:-1])).astype(np.int64)
        before[stop - self.size + 1] = np.searchsorted(self.ids, BEGIN)
        learned = np.repeat(docs["learned"].to_numpy(bool), self.size)
        self.count = np.bincount(self.token[learned], minlength=len(self.ids))
        key, self.pair = np.unique(before * len(self.ids) + self.token, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.context, self.word = key // len(self.ids), key % len(self.ids)
        self.pair_count = np.bincount(self.pair[learned], minlength=len(key))
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), self.size)

    def known(self, replies: pd.DataFrame, owners: int) -> np.ndarray:
        """How often every word of the dictionary was learned in the whole corpus; the begin of a text counts as often as its end."""
        count = read_replies(replies)
        count[np.searchsorted(self.ids, BEGIN)] = count[np.searchsorted(self.ids, END)]
        return count

    def owner_of(self, count: np.ndarray, hot: int, owners: int) -> np.ndarray:
        """The owner of every pair: that of its context, or of a part of it where the context is hot."""
        context, word = self.ids[self.context], self.ids[self.word]
        parts = np.minimum(-(-count[self.context] // hot), owners).astype(np.uint64)
        parts = np.maximum(parts, np.uint64(1))
        return (mix(context + mix(word) % parts * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(owners)).astype(np.int64)


def send_words(docs: pd.DataFrame, owners: int) -> pd.DataFrame:
    group, grp = Group(docs), int(docs["grp"].iloc[0])
    rows = [(o, grp, group.ids[a:b].tobytes(), packed(group.count[a:b])) for o, a, b in cuts(scaled(group.ids, owners))]
    return pd.DataFrame(rows, columns=["owner", "grp", "ids", "counts"])


def _stats(total: np.ndarray) -> list[int]:
    return [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, CUT + 2)]]


def count_words(rows: pd.DataFrame, owners: int) -> pd.DataFrame:
    """For one owner: to every group the corpus counts of its words, and a number for each that no other word of the corpus has, small for
    frequent ones; and once the statistics of all the owner's words."""
    ids, counts = [np.frombuffer(b, np.uint64) for b in rows["ids"]], [unpacked(b) for b in rows["counts"]]
    value, place = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.zeros(len(value), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    number = np.empty(len(value), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(value)) * owners + int(rows["owner"].iloc[0])
    at = np.cumsum([0, *map(len, ids)])
    out = [(g, o, packed(total[place[a:b]]), packed(number[place[a:b]]), None) for g, o, a, b in zip(rows["grp"], rows["owner"], at[:-1], at[1:])]
    out[0] = (*out[0][:4], _stats(total))
    return pd.DataFrame(out, columns=["grp", "owner", "counts", "numbers", "stats"])


def send_pairs(docs: pd.DataFrame, replies: pd.DataFrame, owners: int, hot: int) -> pd.DataFrame:
    if not len(docs):
        return pd.DataFrame(columns=["owner", "grp", "contexts", "runs", "context_counts", "words", "word_counts", "counts", "hot"])
    group, grp = Group(docs), int(docs["grp"].iloc[0])
    known = group.known(replies, owners)
    number = np.concatenate([unpacked(b) for b in replies.sort_values("owner")["numbers"]])
    owner = group.owner_of(known, hot, owners)
    order, rows = np.argsort(owner, kind="stable"), []
    for o, a, b in cuts(owner[order]):
        some = order[a:b]
        runs = cuts(group.context[some])
        context = np.array([c for c, _, _ in runs])
        rows.append((
            o, grp, packed(number[context]), packed(np.array([y - x for _, x, y in runs])), packed(known[context]),
            packed(number[group.word[some]]), packed(known[group.word[some]]), packed(group.pair_count[some]), group.ids[context[known[context] > hot]].tobytes(),
        ))
    return pd.DataFrame(rows, columns=["owner", "grp", "contexts", "runs", "context_counts", "words", "word_counts", "counts", "hot"])


PAIRS = "owner int, grp long, contexts binary, runs binary, context_counts binary, words binary, word_counts binary, counts binary, hot binary"
ANSWERS = "grp long, owner int, counts binary, seen binary, lower binary, stats array<long>, context long, hot_seen array<long>, hot_lower double"


def count_pairs(rows: pd.DataFrame, single: Words, hot: int) -> pd.DataFrame:
    """For one owner: to every group the corpus counts of its pairs, and per context how many words were seen 1 to ``CUT`` times after it and
    the probability of all seen there by themselves. Hot contexts are answered by sums over owners, as rows of their own; once the counts of counts."""
    rows = rows.reset_index(drop=True)
    runs, heads = [unpacked(b) for b in rows["runs"]], [unpacked(b) for b in rows["contexts"]]
    above = [unpacked(b) > hot for b in rows["context_counts"]]
    context = np.concatenate([np.repeat(h, n) for h, n in zip(heads, runs)])
    is_hot = np.concatenate([np.repeat(a, n) for a, n in zip(above, runs)])
    hot_ids = dict(zip(np.concatenate([h[a] for h, a in zip(heads, above)]).tolist(), np.concatenate([np.frombuffer(b, np.int64) for b in rows["hot"]]).tolist()))
    word = np.concatenate([unpacked(b) for b in rows["words"]])
    count = np.concatenate([unpacked(b) for b in rows["counts"]])
    alone = np.concatenate([unpacked(b) for b in rows["word_counts"]])
    order = np.lexsort((word, context))
    head = np.concatenate(([True], (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])))
    first = np.flatnonzero(head)
    total = np.add.reduceat(count[order], first)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(head) - 1
    pair_context = context[order][first]
    value, of = np.unique(pair_context, return_inverse=True)
    seen = np.zeros((len(value), CUT), np.int64)
    small = (total > 0) & (total <= CUT)
    np.add.at(seen, (of[small], total[small] - 1), 1)
    lower = np.bincount(of, weights=np.where(total > 0, single.probability(alone[order][first]), 0), minlength=len(value))
    out, at, corpus = [], 0, total[place]
    for k, n in enumerate(runs):
        size = int(n.sum())
        where = np.searchsorted(value, heads[k])
        out.append((int(rows["grp"][k]), int(rows["owner"][k]), packed(corpus[at : at + size]), packed(seen[where].ravel()), lower[where].tobytes(), None, None, None, None))
        at += size
    out[0] = (*out[0][:5], _stats(total), None, None, None)
    for i in np.unique(of[is_hot[order][first]]).tolist():
        out.append((None, None, None, None, None, None, hot_ids[int(value[i])], seen[i].tolist(), float(lower[i])))
    kinds = {"long": "Int64", "int": "Int32"}  # nullable, as numbers beside nulls would turn into floats
    columns = [c.split() for c in ANSWERS.split(", ")]
    return pd.DataFrame({name: pd.Series(list(values), dtype=kinds.get(kind, "object")) for (name, kind), values in zip(columns, zip(*out))})


def score_step(docs: pd.DataFrame, replies: pd.DataFrame, owners: int, hot: int, single: Words, factor: np.ndarray, sums: tuple[np.ndarray, ...]) -> pd.DataFrame:
    """The rows' results, each token's probability by its pair's count or by backoff."""
    if not len(docs):
        return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    group = Group(docs)
    known = group.known(replies[replies["step"] == 1], owners)
    owner = group.owner_of(known, hot, owners)
    order, answers = np.argsort(owner, kind="stable"), replies[replies["step"] == 2].sort_values("owner")
    count = np.empty(len(order), np.int64)
    count[order] = np.concatenate([unpacked(b) for b in answers["counts"]])
    # per pair, the place of its context's sums in the answers: one entry a run of a context at an owner
    run = np.concatenate(([True], (np.diff(owner[order]) != 0) | (np.diff(group.context[order]) != 0)))
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(run) - 1
    seen = np.concatenate([unpacked(b).reshape(-1, CUT) for b in answers["seen"]])
    lower = np.concatenate([np.frombuffer(b, float) for b in answers["lower"]])
    head = group.context[order][run]
    is_hot = np.flatnonzero(known[head] > hot)
    if len(is_hot):
        at = np.searchsorted(sums[0], group.ids[head[is_hot]])
        seen[is_hot], lower[is_hot] = sums[1][at], sums[2][at]
    occurs = known[head]
    lost = (seen * (1 - factor[1 : CUT + 1]) * np.arange(1, CUT + 1)).sum(axis=1)
    total = occurs + (lost <= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(occurs > 0, np.where(lost > 0, lost, 1) / total / (1 - lower), 1.0)
        found = factor[np.minimum(count, CUT + 1)] * count / total[of]
    chance = np.where(count > 0, found, weight[of] * single.probability(known[group.word]))
    by_word = known[group.token]
    n = len(docs)
    return pd.DataFrame({
        "doc_id": docs["doc_id"], "held_out": ~docs["learned"], "n_tokens": group.size, "n_known": np.bincount(group.doc, weights=by_word > 0, minlength=n).astype(np.int64),
        "train_tokens": single.tokens, "base_score": np.bincount(group.doc, weights=single.base(by_word), minlength=n),
        "score": np.bincount(group.doc, weights=np.log10(chance)[group.pair], minlength=n),
    })


RESULT = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the rows whose id's crc32, as text, is 1 modulo 5; rows without an id are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _summed(table: DataFrame) -> list[int]:
    size = CUT + 3
    row = table.agg(*[F.sum(F.col("stats")[i]) for i in range(size)]).first()
    return [int(x or 0) for x in row]


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = 8_000_000, owner_bytes: int = 6_000_000, hot: int | None = None, written: bool = False
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Null, empty and blank texts are their end alone. Repeated rows are learned from and scored one by one; null ids are learned from. Other columns are
    not read, and an empty table gives no rows; where nothing is learned, every token is the unknown word. Groups hold about ``group_bytes`` of text (at
    least one row). Rows are dealt by their number, so they have to come in a fixed order: pass ``written`` for a
    table read from files; any other frame is written once.
    Contexts with more than ``hot`` occurrences (a 65,536th of all tokens, at least 10,000) are cut, so at most 65,536 sums are broadcast.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows if written else scratch.save(rows)
    size, n = rows.agg(F.sum(F.octet_length("text").cast("long") + 1), F.count(F.lit(1))).first()
    size = (size or 0) + n
    groups, owners = max(1, -(-size // group_bytes)), max(1, -(-size // owner_bytes))
    rows = rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", (~held_out("doc_id")).alias("learned"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp"),
    )
    words = scratch.save(
        rows.groupBy("grp").applyInPandas(lambda d: send_words(d, owners), "owner int, grp long, ids binary, counts binary")
        .groupBy("owner").applyInPandas(lambda r: count_words(r, owners), "grp long, owner int, counts binary, numbers binary, stats array<long>")
    )
    single = Words(_summed(words))
    limit = hot or max(10_000, single.tokens // HOT_CONTEXTS)
    scratch.free()
    pairs = rows.groupBy("grp").cogroup(words.groupBy("grp")).applyInPandas(lambda d, r: send_pairs(d, r, owners, limit), PAIRS)
    counted = scratch.save(pairs.groupBy("owner").applyInPandas(lambda r: count_pairs(r, single, limit), ANSWERS))
    factor = np.ones(CUT + 2)
    factor[1 : CUT + 1] = discounts(_summed(counted)[2:])
    scratch.free()
    sums = _hot_sums(counted.where("context IS NOT NULL"))
    replies = words.select("grp", "owner", "counts", F.lit(None).cast("binary").alias("seen"), F.lit(None).cast("binary").alias("lower"), F.lit(1).alias("step")).unionByName(
        counted.where("grp IS NOT NULL").select("grp", "owner", "counts", "seen", "lower", F.lit(2).alias("step")))
    out = rows.groupBy("grp").cogroup(replies.groupBy("grp")).applyInPandas(lambda d, r: score_step(d, r, owners, limit, single, factor, sums), RESULT)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _hot_sums(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """The sums of the hot contexts, at most ``HOT_CONTEXTS`` rows by the choice of the limit (a caller's own limit aside)."""
    added = rows.groupBy("context").agg(*[F.sum(F.col("hot_seen")[i]).alias(f"s{i}") for i in range(CUT)], F.sum("hot_lower").alias("lower")).collect()
    ids = np.array([r["context"] for r in added], np.int64).view(np.uint64)
    order: Any = np.argsort(ids)
    seen = np.array([[r[f"s{i}"] for i in range(CUT)] for r in added], np.int64).reshape(-1, CUT)
    return ids[order], seen[order], np.array([r["lower"] for r in added], float)[order]


def score_sql(digits: int = 6) -> str:
    """The SQL of ``score_texts``; the begin of a text is a blank, its end an empty word."""
    def spread(source: str, count: str) -> str:
        """Discounts of one table of counts: (r, factor)."""
        n = [f"count(*) FILTER ({count} = {r})::DOUBLE" for r in range(1, CUT + 2)]
        good = f"((r + 1) * n[r + 1] / (r * n[r]) - {CUT + 1} * n[{CUT + 1}] / n[1]) / (1 - {CUT + 1} * n[{CUT + 1}] / n[1])"
        return f"""(SELECT r, CASE WHEN n[1] > 0 AND n[r] > 0 AND {CUT + 1} * n[{CUT + 1}] <> n[1] AND {good} > 0 AND {good} < 1 THEN {good}
    ELSE 1 - n[1] / (n[1] + 2 * greatest(n[2], 1)) / r END AS factor FROM (SELECT [{", ".join(n)}] AS n FROM {source}), range(1, {CUT + 1}) AS t(r))"""

    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 1, false) AS held_out,
  regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS words FROM documents, crc_table),
p AS (SELECT n, held_out, unnest(list_concat([' '], words)) AS v, unnest(list_concat(words, [''])) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM p WHERE NOT held_out GROUP BY w), s AS (SELECT coalesce(sum(c), 0) AS tokens, count(*) AS vocabulary FROM c),
f AS {spread("c", "c")},
e AS (SELECT w, c, c * coalesce(factor, 1) AS kept FROM c LEFT JOIN f ON c = r),
l AS (SELECT coalesce(sum(c - kept), 0) AS lost FROM e), t AS (SELECT tokens + CASE WHEN lost > 0 THEN 0 ELSE 1 END AS total, CASE WHEN lost > 0 THEN lost ELSE 1 END AS lost FROM s, l),
u AS (SELECT w, kept / total AS alone FROM e, t),
b AS (SELECT v, w, count(*) AS k FROM p WHERE NOT held_out GROUP BY v, w),
g AS {spread("b", "k")},
h AS (SELECT v, w, k, k * coalesce(factor, 1) AS kept FROM b LEFT JOIN g ON k = r),
x AS (SELECT v, sum(k) AS seen, sum(k - kept) AS lost, sum(alone) AS lower FROM h JOIN u USING (w) GROUP BY v),
y AS (SELECT v, seen + CASE WHEN lost > 0 THEN 0 ELSE 1 END AS total, (CASE WHEN lost > 0 THEN lost ELSE 1 END) / (seen + CASE WHEN lost > 0 THEN 0 ELSE 1 END) / (1 - lower) AS weight FROM x),
z AS (SELECT n, coalesce(c, 0) AS c, CASE WHEN kept IS NOT NULL THEN kept / y.total ELSE coalesce(weight, 1) * coalesce(alone, t.lost / t.total) END AS chance
  FROM p LEFT JOIN c USING (w) LEFT JOIN u USING (w) LEFT JOIN h USING (v, w) LEFT JOIN y USING (v), t),
q AS (SELECT n, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10((c + 0.5) / (tokens + 0.5 * (vocabulary + 1)))) AS base, sum(log10(chance)) AS score FROM z, s GROUP BY n)
SELECT doc_id, held_out, n_tokens, n_known, CAST(tokens AS BIGINT) AS train_tokens, round(base, {digits}) AS base_score, round(score, {digits}) AS score FROM d JOIN q USING (n), s"""
