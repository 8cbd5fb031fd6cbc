"""Importance resampling against a plain computation."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_DIR
from millrace.llm.importance import Slots, blocks, features, resample
from millrace.llm.words import Stream
from test_operators import DOCS, ROWS


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams_of(words, upto):
    return [" ".join(words[i : i + n]) for n in range(1, upto + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, upto=1, buckets=10_000, min_words=20):
    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(bucket(g) for _, t in docs for g in grams_of(words_of(t), upto))
    t = Counter(bucket(g) for x in target for g in grams_of(words_of(x), upto))
    many, aim, out = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        grams = grams_of(words_of(text), upto)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (many + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in map(bucket, grams))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(fit[: 10 * len(fit) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("upto", [1, 3])
def test_given_documents(spark, upto):
    docs, target = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    want = plain(pairs(docs), [r["text"] for r in target.collect()], upto)
    assert rows_of(resample(docs, target, words=upto, part_rows=7)) == want and sum(r[4] is not None for r in want) > 5


def test_edge_rows(spark):
    """Nulls, empties, repeated rows in a third of the table, ties, clashing names; no target at all."""
    rows = [*ROWS, *[(3, LONG, None, None, None, None, None) for LONG in [" ".join(f"h{i}" for i in range(30))] for _ in range(40)], (None, "n " * 25, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("weight", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("bucket", F.lit(0)).repartition(3)
    for target in ([None, "w1 w2 Ünï", ""], []):
        frame = spark.createDataFrame([(t,) for t in target], "text string")
        assert rows_of(resample(docs, frame, part_rows=4)) == plain(pairs(docs), target)
    assert resample(docs.where("doc_id < 0"), frame).count() == 0


def test_long_texts_are_cut_between_words():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abÄ .-7\n"), 5000)) + "x" * 900 + " end"
    for upto in (1, 2, 4):
        got, count = Counter(), 0
        for parts in blocks([None, text, "", "A b"], upto, 200):
            stream, start, length, _, new = features(parts, upto)
            got.update(bytes(stream.feature(a, n)).decode() for a, n in zip(start, length))
            count += len(new)
        assert got == Counter(grams_of(words_of(text), upto)) + Counter(grams_of(["a", "b"], upto)) and count == len(words_of(text)) + 2


def test_keys_and_slots():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 4000).astype(np.uint8)
    stream, start, length = Stream(raw), rng.integers(0, 3900, 3000), rng.integers(1, 90, 3000)
    length[:2000] %= 5
    length[:2000] += 1
    keys = stream.hashes(start, length)
    spelled = [raw[a : a + n].tobytes() for a, n in zip(start, length)]
    assert [int(k) for k in keys] == [xxhash.xxh64_intdigest(w) for w in spelled]
    for hashes in (keys, keys & np.uint64(3), keys * np.uint64(0)):  # also where many features have one key: their bytes decide
        slots = Slots(stream, start, length, 10_000, hashes)
        by_slot = {}
        assert all(by_slot.setdefault(s, w) == w for s, w in zip(slots.of.tolist(), spelled)) and len(by_slot) == len(set(spelled)) == len(slots.used)
        assert all(slots.bucket[s] == zlib.crc32(w) % 10_000 for s, w in by_slot.items())
        assert {by_slot[s]: int(slots.count[s]) for s in by_slot} == Counter(spelled)
