"""Training-data operators against plain definitions, on small tables with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_DIR
from millrace.llm import toxicity as tox
from millrace.llm.exactdedup import CuckooIndex, drop_copies, exact_groups
from millrace.llm.langid import BLOCK, _fitted, _plain, identify, learn, phrases
from millrace.llm.mixing import TEMPER, mix_documents
from millrace.llm.neardup import Tree, fingerprint, link, near_groups
from millrace.llm.pieces import MODEL, decode, encode, segment_sorted
from millrace.llm.repeats import _both_in, remove_repeats, symbols
from millrace.llm.shards import assign_shards
from millrace.llm.tokencount import CountTrie, count_tokens, pre_tokens
from millrace.llm.topk import top_k
from millrace.llm.unigram import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, print long"
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a", 1, None, None), (2, LONG.replace(" ", "\n"), "en", "a", 1, "x", 3), (3, "pre " + LONG + " post", "en", None, 1, "x", 3),
    (4, "", "en", "a", 0, None, None), (5, None, None, None, None, None, None), (6, "a " * 300, "fr", "b", 1, None, None), (7, "a " * 80 + "b", "fr", "b", 1, None, None),
    (8, "Ünï ▁ mark\t\x0b tab  two blanks\n\nend 123", "de", "b", 1, None, None), (9, "12 34 !!", "de", "b", 1, None, None), (None, "no id here", "en", "a", 1, None, None),
    (11, "x" * 5000, "en", "a", 1, None, None), (11, "x" * 5000, "en", "a", 1, None, None), (12, " ".join(f"u{i}" for i in range(40)), "es", "c", 1, None, None), (13, " \t\n", "es", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def smallest(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["docs", "small"])
def test_near_groups(request, name):
    frame = request.getfixturevalue(name)
    rows = pairs_of(frame)
    prints = {plain_print(t) for _, t in rows}
    root = smallest(prints, [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[plain_print(t)]
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{plain_print(t):016x}", least.get(root[plain_print(t)])) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in near_groups(frame).collect()), key=repr) == want


def test_tree_keeps_all_links():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = prints[rng.integers(0, 3000, 3000)].copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    prints = np.unique(np.concatenate([prints, near]))
    want = link(prints, leaf=10**9)
    assert (link(prints, leaf=64) == want).all()
    tree = Tree(prints[::7], 5)
    shard, at = tree.shards(prints)
    assert tree.leaves > 8 and set(at) == set(range(len(prints)))
    links = [(prints[a], prints[b]) for a, b in enumerate(want) if a != b]
    together = set(zip(shard.tolist(), prints[at].tolist()))
    i, j = np.nonzero(np.bitwise_count(prints[:2000, None] ^ prints[None, :]) <= 2)
    assert links and all(any((s, int(prints[a])) in together and (s, int(prints[b])) in together for s in range(tree.leaves)) for a, b in zip(i[:4000], j[:4000]) if a != b)


def test_cuckoo_index_resizes_and_forgets():
    index, keys = CuckooIndex(2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for k in keys:
        index.add(k, 1)
    assert len(index) == 3000 and all(index.find(k) for k in keys)
    assert all(index.remove(k) for k in keys[::2]) and not index.remove(keys[0])
    assert len(index) == 1500 and not any(index.find(k) for k in keys[::2]) and all(index.find(k) for k in keys[1::2])


def test_exact_groups(docs):
    got = exact_groups(docs).collect()
    plain = {r["text_sha256"]: [g for g in got if g["text_sha256"] == r["text_sha256"]] for r in got}
    assert len(got) == len(ROWS)
    for i, text in {(r[0], r[1]) for r in ROWS}:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        group = plain[digest]
        same = [r for r in ROWS if re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") == re.sub(r"[\x20\x09-\x0D]", "", text or "")]
        best = min(same, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert len(group) == len(same) and sum(g["kept"] for g in group) == 1
        assert {(g["keep_id"], g["group_size"]) for g in group} == {(best[0], len(same))}
    stay = drop_copies(docs)
    assert stay.columns == docs.columns and Counter(r["doc_id"] for r in stay.collect()) == Counter(g["doc_id"] for g in got if g["kept"])


def test_shards(spark, small):
    hot = spark.createDataFrame([(i, "hot text " * 9) for i in range(3000)] + [(5000 + i, "t" * (i % 90)) for i in range(6000)] + [(None, None)], "doc_id long, text string")
    got = assign_shards(hot, shards=8, part_rows=200).toPandas()
    assert len(got) == 9001 and (got.law == "bytes").all() and got.grown_shard.isna().all()
    assert got["size"].sum() == sum(len(t or "") + 1 for _, t in pairs_of(hot))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 0.01 * sums.mean()
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    assert got.text_crc32[got.doc_id == 7].item() == zlib.crc32(b"hot text " * 9)


@pytest.mark.parametrize("row", [(7, "the same row " * 6), (None, "no id " * 11), (7, None)])
def test_shards_cut_repeated_rows(spark, row):
    """A third of the table is one row."""
    frame = spark.createDataFrame([row] * 2000 + [(100 + i, "t" * (i % 90)) for i in range(4000)], "doc_id long, text string").withColumn("key", F.lit(1)).repartition(5)
    got = assign_shards(frame, shards=8, part_rows=200).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 6000 and len(sums) == 8 and sums.max() - sums.min() <= 0.02 * sums.mean()
    assert all(sorted(rows.slot) == list(range(len(rows))) for _, rows in got.groupby("shard"))


def plain_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["docs", "small"])
@pytest.mark.parametrize("window", [35, 5])
def test_repeats(request, name, window):
    frame = request.getfixturevalue(name)
    got = remove_repeats(frame, window=window, group_bytes=3000, range_bytes=2000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_repeats(pairs_of(frame), window)


def test_repeats_of_colliding_words_and_rows(spark):
    """Words that collide in any polynomial hash modulo 2**64; a third of the rows alike, with and without ids; a very long text."""
    odd, even = "".join("ab"[i.bit_count() % 2] for i in range(1024)), "".join("ba"[i.bit_count() % 2] for i in range(1024))
    tail = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{odd} {tail}"), (2, f"{even} {tail}"), (3, " ".join(f"u{i % 9000}" for i in range(30_000)))]
    rows += [(None, "one row " * 30)] * 40 + [(4, "and another " * 25)] * 40 + [(100 + i, " ".join(f"d{i}x{j}" for j in range(50))) for i in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in remove_repeats(frame, group_bytes=3000, range_bytes=2000).collect()), key=repr)
    assert got == plain_repeats(rows, 35) and [r[2] for r in got if r[0] in (1, 2)] == [0, 0]


def test_windows_match_by_both_hashes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 40, 400):
        known = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (n, 2))})
        pair = np.array(known, np.int64).reshape(-1, 2)
        value, extra = rng.integers(0, 14, 300).astype(np.uint64), rng.integers(0, 14, 300).astype(np.uint32)
        got = _both_in((pair[:, 0].astype(np.uint64), pair[:, 1].astype(np.uint32)), value, extra)
        assert got.tolist() == [(int(a), int(b)) in known for a, b in zip(value, extra)]


def test_equal_passages_get_equal_names():
    rng = np.random.default_rng(3)
    for alphabet in (3, 50):
        passage = rng.integers(1, alphabet, 60).astype(np.uint64)
        held = []
        for before, after in ((7, 4), (12, 30)):
            words = np.concatenate([rng.integers(1, alphabet, before), passage, rng.integers(1, alphabet, after)]).astype(np.uint64)
            name, low, high = symbols(words)
            inside = (low >= before) & (high <= before + 60)
            held.append({(n, a - before, b - before) for n, a, b in zip(name[inside], low[inside], high[inside])})
        assert held[0] == held[1] and (alphabet == 3 or held[0])


def test_automaton_parses_greedily(small):
    texts = [r["text"] for r in small.limit(12).collect()]
    samples = (("a", _plain(texts[0])[:3000]), ("b", b"zzz 12"))
    classes, _ = _fitted(samples)
    got = phrases([_plain(t) for t in texts], samples)
    for k, (_, sample) in enumerate(samples):
        known = bytes(classes[np.frombuffer(sample, np.uint8)])
        for j, text in enumerate(texts):
            raw, n = bytes(classes[np.frombuffer(_plain(text), np.uint8)]), 0
            for at in range(0, len(raw), BLOCK):
                block, i = raw[at : at + BLOCK], 0
                while i < len(block):
                    end = i + 1
                    while end < len(block) and block[i : end + 1] in known:
                        end += 1
                    n, i = n + 1, end
            assert abs(got[k, j] - n) <= sum(c not in known for c in raw)  # an unknown byte may end or be a phrase


def test_identify(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9 and got.score.between(0, 1).all()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    by_id = {r["doc_id"]: r for r in identify(docs).collect()}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (4, 5, 9, 13)) and by_id[8]["lang_pred"] != "und"


def test_samples_of_repeated_ids(spark):
    """A hot id takes one place of the sample, whatever its rows; ids without label and held-out ids take none."""
    rows = [(1, f"copy {i:03d}", "en") for i in range(300)] + [(i, f"row {i}", "en") for i in range(2, 40)] + [(50, "un texte", "fr"), (51, "no label", None), (None, "no id", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = dict(learn(frame))
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2}
    want = {f"row {i}" for i in range(2, 40) if i not in held} | ({"copy 000"} - ({"copy 000"} if 1 in held else set()))
    assert set(got["en"].decode().split("\n")) == want and set(got) == {"en"} | ({"fr"} if 50 not in held else set())
    assert len(dict(learn(frame, sample_docs=5))["en"].split(b"\n")) == 5 and set(dict(learn(frame, sample_chars=3))["en"].split(b"\n")) <= {b"row", b"cop"}
    with pytest.raises(ValueError):
        learn(spark.range(500).selectExpr("id AS doc_id", "'a' AS text", "CAST(id AS STRING) AS lang"), all_bytes=256, sample_docs=2)


def plain_viterbi(unit, v):
    best = [(0.0, [])]
    for end in range(1, len(unit) + 1):
        made = [(best[b][0] + v.scores[unit[b:end]], [*best[b][1], v.ids[unit[b:end]]]) for b in range(end) if unit[b:end] in v.scores]
        if not made:
            gain, spelled = v.fallback(unit[end - 1])
            made = [(best[end - 1][0] + gain, [*best[end - 1][1], *spelled])]
        best.append(max(made, key=lambda m: m[0]))
    return best[-1]


def test_pieces_and_counts(docs, small):
    v = load(MODEL)
    texts = [t for _, t in pairs_of(docs) if t and len(t) < 2000] + [r["text"] for r in small.limit(20).collect()]
    units = sorted({u for t in texts for u in pre_tokens(t)})
    assert all("".join(pre_tokens(t)) == " " + t for t in texts)
    trie, tiny = CountTrie(v), CountTrie(v, nodes=50, deep=4)
    for unit, packed in segment_sorted(units, v):
        score, want = plain_viterbi(unit, v)
        ids = np.frombuffer(packed, np.int32).tolist()
        gain = sum(v.scores[p] if p else v.byte_score for p in ({k: p for p, k in v.ids.items()}.get(i) for i in ids)) if unit in units[:40] else score
        assert math.isclose(gain, score, rel_tol=1e-9) and trie.insert(unit) == tiny.insert(unit) and trie.insert(unit) <= len(want)
    got = encode(docs)
    assert {r["exact"] for r in got.collect()} == {True, None}
    assert Counter((r["doc_id"], r["text"]) for r in decode(got).collect()) == Counter(pairs_of(docs))
    counted = {r["doc_id"]: r for r in count_tokens(docs).collect()}
    assert counted[4]["n_tokens"] == counted[5]["n_tokens"] == 0 and counted[1]["n_pre_tokens"] == 60
    assert counted[8]["n_tokens"] == trie.count(pre_tokens(next(t for i, t in pairs_of(docs) if i == 8)))


def test_gradients():
    rng = np.random.default_rng(5)
    features = tox.Features(["alpha", "beta", "gamma", "delta", "x"])
    net = tox.Network(rng.standard_normal((2, tox.BUCKETS)) * 0.3)
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    x = np.concatenate([np.zeros((1, features and net.inputs(features).shape[1])), net.inputs(features)])
    ids = np.array([[1, 2, 3, 4, 0, 0], [5, 4, 1, 1, 2, 3]], np.int32)
    weight, keep = np.array([0.7, -1.3]), {}
    net.forward(net.project(x), ids, keep)
    grads, _ = net.backward(keep, weight, len(x))
    for name in ("a", "v", "o", "uf", "ub", "k"):
        at = tuple(0 for _ in net.p[name].shape)
        base = net.p[name][at]
        both = []
        for step in (1e-2, -1e-2):
            net.p[name][at] = base + step
            both.append(float(net.forward(net.project(x), ids) @ weight))
        net.p[name][at] = base
        assert abs((both[0] - both[1]) / 2e-2 - grads[name][at]) < 2e-3


def test_toxicity(spark, docs):
    folder = "/root/testdata/sf0.01"
    big, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = tox.score_toxicity(big, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, calm = got.score[got.toxic == 1], got.score[got.toxic == 0]
    assert (toxic.to_numpy()[:, None] > calm.to_numpy()[None, :]).mean() > 0.75 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert tox.learn(big.unionByName(big).unionByName(big), labels, positives=3, negatives=4) is not None  # each id counts once
    none = tox.score_toxicity(docs, labels.where("doc_id < 0")).collect()
    assert len(none) == len(ROWS) and {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert tox.windows_of(np.arange(1, 50)).shape == (3, tox.WINDOW) and tox.words_of("Ab " + "c" * 100) == ["ab", "c" * 48, "c" * 48, "c" * 4]


def test_mixing_meets_targets(small):
    got = mix_documents(small).toPandas()
    factor = got.weight * got.probability
    total = got.n_tokens.sum()
    for margin in ("source", "lang", "topic"):
        want = got.groupby(margin).n_tokens.sum() ** TEMPER[margin]
        have = (got.n_tokens * factor).groupby(got[margin]).sum() / total
        assert ((want / want.sum()) - have).abs().max() < 0.01


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.standard_normal(10) / 3).tolist()) for i in range(400)] + [(400 + i, [0.25] * 10) for i in range(200)]
    vectors += [(700, None), (750, [1.0, None] * 5), (800, [float("nan")] * 10), (850, [1.0] * 3), (50, vectors[50][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).repartition(4)
    got = [tuple(r) for r in top_k(frame, F.col("vec_id") % 50 == 0, slice_rows=100, query_rows=4).collect()]
    sound = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in sound if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


def test_empty_tables(spark, docs):
    none, labels = docs.where("doc_id < 0"), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for made in (near_groups(none), exact_groups(none), assign_shards(none), remove_repeats(none), identify(none), encode(none), count_tokens(none), tox.score_toxicity(none, labels), mix_documents(none), top_k(vectors, F.col("vec_id") % 50 == 0), drop_copies(none)):
        assert made.count() == 0
