"""Katz scores against plain dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from conftest import SF_DIR
from millrace.llm import katz
from millrace.llm.exchange import cuts, packed, unpacked
from millrace.llm.katz import CUT, discounts, score_texts
from test_operators import DOCS, ROWS


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def plain_discount(counts):
    n = [sum(c == r for c in counts) for r in range(CUT + 2)]
    out = {}
    for r in range(1, CUT + 1):
        good = None
        if n[1] and n[r] and (CUT + 1) * n[CUT + 1] != n[1]:
            common = (CUT + 1) * n[CUT + 1] / n[1]
            good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out[r] = good if good is not None and 0 < good < 1 else 1 - n[1] / (n[1] + 2 * max(n[2], 1)) / r
    return lambda c: out.get(c, 1.0) * c


class Plain:
    def __init__(self, rows):
        learned = [tokens_of(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
        self.c = Counter(w for ws in learned for w in ws)
        self.n = sum(self.c.values())
        self.after = defaultdict(Counter)
        for ws in learned:
            for v, w in zip([" ", *ws], ws):
                self.after[v][w] += 1
        self.one, self.two = plain_discount(self.c.values()), plain_discount([k for a in self.after.values() for k in a.values()])
        lost = math.fsum(c - self.one(c) for c in self.c.values())
        self.total, self.rest = self.n + (not lost > 0), lost if lost > 0 else 1

    def alone(self, w):
        return self.one(self.c[w]) / self.total if w in self.c else self.rest / self.total

    def chance(self, v, w):
        seen = self.after.get(v)
        if seen is None:
            return self.alone(w)
        lost = math.fsum(k - self.two(k) for k in seen.values())
        total = sum(seen.values()) + (not lost > 0)
        if w in seen:
            return self.two(seen[w]) / total
        return (lost if lost > 0 else 1) / total / (1 - math.fsum(map(self.alone, seen))) * self.alone(w)

    def row(self, i, text):
        ws = tokens_of(text)
        base = math.fsum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (len(self.c) + 1))) for w in ws)
        score = math.fsum(math.log10(self.chance(v, w)) for v, w in zip([" ", *ws], ws))
        return i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(w in self.c for w in ws), self.n, base, score


def agree(frame, **how):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    model = Plain(rows)
    want = sorted((model.row(i, t) for i, t in rows), key=repr)
    got = sorted((tuple(r) for r in score_texts(frame, **how).collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-11, atol=1e-9)
    return model


@pytest.mark.parametrize("hot", [None, 1, 7])
def test_edge_rows(spark, hot):
    agree(spark.createDataFrame(ROWS, DOCS).repartition(3), hot=hot, group_bytes=500, owner_bytes=300)


def test_given_documents(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    agree(frame, written=True, hot=100, group_bytes=40_000, owner_bytes=20_000)
    model = agree(frame, written=True)
    for v in [" ", *list(model.after)[:40]]:  # every context's probabilities sum to one, the unknown word included
        assert math.isclose(math.fsum(model.chance(v, w) for w in model.c) + model.chance(v, "\0"), 1, rel_tol=1e-9)


def test_repeated_rows_and_no_training(spark):
    """A third of the rows alike; all rows held out; nothing at all."""
    rows = [(7, "same words again and again")] * 300 + [(i, f"word{i % 9} and word{i % 7}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    agree(frame, group_bytes=2_000, owner_bytes=1_000, hot=50)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    unseen = score_texts(spark.createDataFrame([(i, "some text") for i in held], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in unseen} == {(3, 0, 0, 0.0)}
    assert score_texts(frame.where("doc_id < 0")).count() == 0


def test_long_text(spark):
    frame = spark.createDataFrame([(1, "tick tock " * 150_000), (2, "tock tick"), (3, "x" * 400_000)], "doc_id long, text string")
    agree(frame, group_bytes=10_000, owner_bytes=100_000)


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 2**40):
        count = rng.integers(0, top, 300)
        assert (unpacked(packed(count)) == count).all()
    assert len(unpacked(packed(np.empty(0, np.int64)))) == 0


def test_rows_of_messages_do_not_grow_with_owners():
    """A group sends at most a row a pair, however many owners there are."""
    rng = np.random.default_rng(2)
    for owners in (10, 10**6, 10**9):
        owner = np.sort(rng.integers(0, owners, 5000))
        assert len(cuts(owner)) == len(np.unique(owner)) <= 5000


def test_discounts_lie_between_zero_and_one():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [10, 4, 3, 2, 1, 1], [1, 9, 0, 3, 8, 50], [6, 1, 1, 1, 1, 1]):
        factor = discounts(n)
        assert (factor > 0).all() and (factor <= 1).all() and (n[0] == 0 or (factor < 1).all())


def test_pairs_travel_as_numbers():
    """The words of a pair take fewer bytes than a hash, and no two words share a number, however many owners there are."""
    rng, owners = random.Random(3), 5
    docs = pd.DataFrame({"text": [" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(200)) for _ in range(100)], "learned": True, "grp": 0})
    asked = katz.send_words(docs, owners)
    told = pd.concat([katz.count_words(g, owners) for _, g in asked.groupby("owner")])
    numbers = np.concatenate([unpacked(b) for b in told["numbers"]])
    assert len(set(numbers.tolist())) == len(numbers) == len(katz.Group(docs).ids)
    sent = katz.send_pairs(docs, told, owners, 500)
    assert sum(len(b) for b in sent["words"]) < 4 * sum(int(unpacked(b).sum()) for b in sent["runs"])
    assert 0 < sum(len(b) for b in sent["hot"]) < sum(8 * len(unpacked(b)) for b in sent["contexts"])
