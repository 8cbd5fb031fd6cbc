"""The near-copy join against brute force over whole shingle sets."""

from __future__ import annotations

import inspect
import random
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import nearcopies
from millrace.llm.exchange import replies
from millrace.llm.nearcopies import is_near, keep_one, near_links, shared, shingles
from millrace.session import Scratch
from test_operators import DOCS, ROWS, smallest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], COLUMNS).repartition(4)


def kept(spark, rows):
    return sorted((r["doc_id"], r["text"]) for r in keep_one(frame(spark, rows)).collect())


def plain(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def text_of(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def changed(rng, words, times):
    out = list(words)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def test_similarity_is_jaccard():
    rng = random.Random(3)
    words = text_of(rng, 80)
    for times in range(8):
        a, b = " ".join(words), " ".join(changed(rng, words, times)).upper()
        both = plain(a) & plain(b)
        assert shared(shingles(a), shingles(b)) == len(both) and is_near(shingles(a), shingles(b)) == (5 * len(both) >= 4 * len(plain(a) | plain(b)))
    assert is_near(shingles("a b c"), shingles("A  b\nC")) and not is_near(shingles("a b c"), shingles("a b"))
    assert is_near(shingles(None), shingles(" \n"))
    odd, even = "".join("ab"[i.bit_count() % 2] for i in range(1024)), "".join("ba"[i.bit_count() % 2] for i in range(1024))
    assert not is_near(shingles(odd), shingles(even))  # words that collide in any polynomial hash modulo 2**64


def test_planted_near_copies_go(spark):
    """Copies from 0.8 up: each is 200 words with one to four words changed, and most differ in more than two SimHash bits."""
    rng, rows, near, far = random.Random(5), [], 0, 0
    for i in range(150):
        words = text_of(rng, 200)
        copy = changed(rng, words, 1 + i % 6)
        a, b = plain(" ".join(words)), plain(" ".join(copy))
        close = len(a & b) / len(a | b) >= 0.8
        near, far = near + close, far + (not close)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    assert near >= 90 and far >= 20
    found = [i for i, _ in kept(spark, rows)]
    lost = [i for i in range(0, 300, 2) if i not in found]
    left = sum(i % 2 for i in found)
    assert lost == [] and left == far  # recall 1.0 here, and nothing else goes


def test_groups_are_those_of_brute_force(spark):
    """A crowd around one text, whose members are near one another only in part, so that bridges count."""
    rng = random.Random(7)
    words = text_of(rng, 120)
    rows = [(i, " ".join(changed(rng, words, rng.randrange(1, 7)))) for i in range(120)]
    sets = {i: plain(t) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    root = smallest(sets, links)
    want = sorted((i, t) for i, t in rows if root[i] == i)
    assert 1 < len(want) < 120 and kept(spark, rows) == want


def links_of(spark, rows):
    scratch = Scratch(spark)
    texts = scratch.save(spark.createDataFrame(rows, "row long, text string").repartition(4))
    return {(r["a"], r["b"]) for r in near_links(texts, scratch, group_bytes=4_000, owner_bytes=2_000).collect()}


@pytest.mark.parametrize("stars", [0, 1, 6])
def test_links_connect_what_brute_force_does(spark, monkeypatch, stars):
    """Texts of shared passages, ends and single words in all mixtures, so that pairs lie on both sides of the bound."""
    monkeypatch.setattr(nearcopies, "STARS", stars)
    rng = random.Random(11)
    parts = [text_of(rng, n) for n in (5, 8, 20, 40, 60, 60)]
    rows = [(i, " ".join(sum(rng.sample(parts, rng.randrange(1, 5)), text_of(rng, rng.choice([0, 0, 1, 6, 15]))))) for i in range(160)]
    rows += [(200 + i, t) for i, (_, t, *_) in enumerate(ROWS)]
    sets = {i: plain(t or "") for i, t in rows}
    near = {(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = {tuple(sorted(p)) for p in links_of(spark, rows)}
    assert got <= near and smallest(sets, got) == smallest(sets, near) and len(near) > 20


def test_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Texts that share 90 of 110 words are no near copies: not one pair is compared, however many there are. A crowd of real near copies takes
    pairs in proportion to its rows."""
    compared = []
    real = nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, sets: compared.append(pairs.count()) or real(pairs, sets))
    rng = random.Random(13)
    passage, base = text_of(rng, 90), text_of(rng, 200)
    rows = [(i, " ".join(text_of(rng, 10) + passage + text_of(rng, 10))) for i in range(2000)]
    assert links_of(spark, rows) == set() and sum(compared) == 0
    for size in (300, 900):
        compared.clear()
        rows = [(i, " ".join(changed(rng, base, rng.randrange(4)))) for i in range(size)]
        assert len(smallest(range(size), links_of(spark, rows))) == size and sum(compared) < 8 * size


def test_rows_are_decided_one_by_one(spark):
    """One id on two different texts, a group without ids, and repeated rows."""
    rng = random.Random(17)
    text, other, third = (" ".join(text_of(rng, 100)) for _ in range(3))
    rows = [(1, text), (2, text + " end"), (2, other), (None, third), (None, third + " end"), (None, third), (5, None), (6, ""), (4, " ")]
    got = keep_one(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").coalesce(1))
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, text), (2, other), (None, third), (4, " ")], key=repr)
    assert keep_one(got.where("doc_id < 0")).count() == 0


def test_simhash_finds_the_close_ones(spark, monkeypatch):
    """Fingerprints at two bits or fewer are linked and compared before any shingle is joined."""
    seen = []
    real = nearcopies.simhash_pairs

    def watched(marked, scratch):
        pairs = real(marked, scratch)
        seen.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(nearcopies, "simhash_pairs", watched)
    rng = random.Random(19)
    words = text_of(rng, 2000)
    rows = [(0, " ".join(words)), (1, " ".join([*words, "end"])), (2, " ".join(text_of(rng, 300)))]
    assert (nearcopies.simhash(shingles(rows[0][1])) ^ nearcopies.simhash(shingles(rows[1][1]))).bit_count() <= 2
    scratch = Scratch(spark)
    got = near_links(scratch.save(spark.createDataFrame(rows, "row long, text string")), scratch).collect()
    assert seen == [(1, 0)] and {tuple(sorted(r)) for r in got} == {(0, 1)}


def test_a_group_of_texts_needs_little_memory():
    """What counting and marking a group of the default size hold in arrays: two of them go beside Spark in a small executor."""
    rng, size = random.Random(17), inspect.signature(near_links).parameters["group_bytes"].default
    words = text_of(rng, 20_000)
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(size // 6_890)]
    docs = pd.DataFrame({"text": texts, "row": range(len(texts)), "grp": 0})
    tracemalloc.start()
    try:
        asked = nearcopies._ask(docs, 3)
        answers = pd.concat([replies(g) for _, g in asked.groupby("owner")])
        nearcopies._mark(docs, answers)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 130_000_000
