"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words. A word's input joins what is known of the word with what is known of its characters (hashed prefixes
and trigrams), so unseen forms of known stems count. Two gated recurrent layers read a window from both
ends, attention weighs the positions, and a logistic unit scores the pooled state. A text's score is that of its highest window.
The network is trained in numpy with its gradients written out, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix

WINDOW, STRIDE = 32, 16
BUCKETS, WORD_DIM, GRAM_DIM, FIXED, STATE, ATTEND = 1 << 15, 6, 7, 3, 8, 8
LONGEST = 48  # characters of a word read at once; a longer one is read as several
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


class Features:
    """Hashed features of words: one bucket a word, and the buckets of the prefixes and trigrams of its letters, flat."""

    def __init__(self, words: list[str]) -> None:
        marked = [f"<{w.strip(_SIGNS) or w}>" for w in words]
        size = np.array([len(m) for m in marked], np.int64)
        width = max(8, int(size.max(initial=0)))
        codes = np.array(marked, f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
        k = np.uint64(0x9E3779B97F4A7C15)
        run, heads = codes[:, 0] * k, []
        for i in range(1, width):
            run = (run + codes[:, i]) * k
            if 2 <= i <= 7:
                heads.append(mix(run + np.uint64(i)))
        grams = np.stack([*heads, *(mix(((codes[:, i] * k + codes[:, i + 1]) * k + codes[:, i + 2]) * k) for i in range(width - 2))], axis=1)
        real = np.stack([*(size > i for i in range(2, 8)), *(size > i + 2 for i in range(width - 2))], axis=1)
        real[:, 0] |= size <= 2
        self.word = (mix(run) % np.uint64(BUCKETS)).astype(np.int64)
        self.gram = (grams[real] % np.uint64(BUCKETS)).astype(np.int64)
        self.count = real.sum(axis=1)

    def __len__(self) -> int:
        return len(self.word)

    def starts(self) -> np.ndarray:
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(self.count)[:-1]))[: len(self)]


class Words:
    """Row numbers for words, from 1; row 0 is padding. ``fresh`` holds those met since it was last emptied."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.fresh: list[str] = []

    def of(self, words: list[str]) -> np.ndarray:
        for word in set(words).difference(self.rows):
            self.rows[word] = len(self.rows) + 1
            self.fresh.append(word)
        return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))


def windows_of(rows: np.ndarray) -> np.ndarray:
    """All windows of a text: every STRIDE words one, until its end is covered; padded with 0."""
    n = max(1, -(-(len(rows) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward pass and gradients. ``prior`` has log-odds per word and per gram, learned by counting and left fixed."""

    def __init__(self, prior: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        inputs = FIXED + WORD_DIM + GRAM_DIM
        normal = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.prior = prior.astype(np.float32)
        self.p = {
            "word": normal(BUCKETS, WORD_DIM), "gram": normal(BUCKETS, GRAM_DIM),
            **{f"w{s}": normal(inputs, 3 * STATE) for s in "fb"}, **{f"u{s}": normal(STATE, 3 * STATE) for s in "fb"},
            **{f"c{s}": np.zeros(3 * STATE, np.float32) for s in "fb"},
            "a": normal(2 * STATE, ATTEND), "v": normal(ATTEND), "o": normal(2 * STATE), "k": np.full(1, -2, np.float32),
        }

    def inputs(self, features: Features) -> np.ndarray:
        """The input vector of each word."""
        out = np.zeros((len(features), FIXED + WORD_DIM + GRAM_DIM), np.float32)
        if len(features):
            starts, odds = features.starts(), self.prior[1][features.gram]
            out[:, 0] = self.prior[0][features.word]
            out[:, 1] = np.maximum.reduceat(odds, starts)
            out[:, 2] = np.add.reduceat(odds, starts) / features.count
            out[:, FIXED : FIXED + WORD_DIM] = self.p["word"][features.word]
            out[:, FIXED + WORD_DIM :] = np.add.reduceat(self.p["gram"][features.gram], starts) / features.count[:, None]
        return out

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """Each word's share of the gates, in both directions: computed once a word, used wherever it stands."""
        return {s: inputs @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"}

    def _read(self, gates: np.ndarray, ids: np.ndarray, s: str, keep: list | None) -> np.ndarray:
        n, length = ids.shape
        h, out, u = np.zeros((n, STATE), np.float32), np.empty((length, n, STATE), np.float32), self.p[f"u{s}"]
        for t in range(length) if s == "f" else range(length - 1, -1, -1):
            x, m, real = gates[ids[:, t]], h @ u, (ids[:, t] > 0)[:, None]
            zr = _sigmoid(x[:, : 2 * STATE] + m[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            c = np.tanh(x[:, 2 * STATE :] + r * m[:, 2 * STATE :])
            after = np.where(real, c + z * (h - c), h)
            if keep is not None:
                keep.append((t, h, z, r, c, m, real))
            out[t] = h = after
        return out

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The score before the logistic of each window."""
        steps = {s: [] if keep is not None else None for s in "fb"}
        states = np.concatenate([self._read(gates[s], ids, s, steps[s]) for s in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["a"])
        energy = np.where((ids > 0).T, hidden @ self.p["v"], -1e9)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        if keep is not None:
            keep.update(steps=steps, states=states, hidden=hidden, weight=weight, pooled=pooled, ids=ids)
        return pooled @ self.p["o"] + self.p["k"][0]

    def backward(self, keep: dict, d_out: np.ndarray, n_words: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the recurrent and output parameters, and of each word's gate shares."""
        p, states, hidden, weight, ids = self.p, keep["states"], keep["hidden"], keep["weight"], keep["ids"]
        g = {"o": keep["pooled"].T @ d_out, "k": d_out.sum(keepdims=True)}
        d_pooled = d_out[:, None] * p["o"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nd,tnd->tn", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * p["v"] * (1 - hidden**2)
        g["a"] = np.einsum("tnd,tna->da", states, d_hidden)
        d_states = d_states + d_hidden @ p["a"].T
        d_gates = {}
        for i, s in enumerate("fb"):
            from_above, d_h = d_states[:, :, i * STATE : (i + 1) * STATE], np.zeros((len(ids), STATE), np.float32)
            u, d_u, d_x = p[f"u{s}"], np.zeros_like(p[f"u{s}"]), np.zeros((n_words, 3 * STATE), np.float32)
            for t, h, z, r, c, m, real in reversed(keep["steps"][s]):
                d_h = d_h + from_above[t]
                d_c, d_z = d_h * (1 - z), d_h * (h - c)
                d_cx = d_c * (1 - c**2)
                d_r = d_cx * m[:, 2 * STATE :]
                d_zr = np.concatenate([d_z * z * (1 - z), d_r * r * (1 - r)], axis=1)
                d_all = np.where(real, np.concatenate([d_zr, d_cx], axis=1), 0).astype(np.float32)
                d_m = d_all.copy()
                d_m[:, 2 * STATE :] *= r
                d_u += h.T @ d_m
                np.add.at(d_x, ids[:, t], d_all)
                d_h = np.where(real, d_h * z, d_h) + d_m @ u.T
            g[f"u{s}"], d_gates[s] = d_u, d_x
        return g, d_gates


class Trainer:
    """Adam over the dense parameters; the embeddings take plain scaled steps at the buckets a batch has met."""

    def __init__(self, net: Network, words: list[str], rate: float = 0.01) -> None:
        self.net, self.words, self.rate, self.step = net, words, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("word", "gram")}
        self.s = {k: np.zeros_like(v) for k, v in self.m.items()}

    def fit(self, ids: np.ndarray, labels: np.ndarray) -> None:
        met, small = np.unique(np.concatenate(([0], ids.ravel())), return_inverse=True)
        small = small[1:].reshape(ids.shape).astype(np.int32)
        some = Features([self.words[i - 1] for i in met[1:]])
        x, keep = np.concatenate([np.zeros((1, FIXED + WORD_DIM + GRAM_DIM), np.float32), self.net.inputs(some)]), {}
        out = self.net.forward(self.net.project(x), small, keep)
        d_out = ((_sigmoid(out) - labels) / len(labels)).astype(np.float32)
        g, d_gates = self.net.backward(keep, d_out, len(met))
        d_x = sum(d_gates[s] @ self.net.p[f"w{s}"].T for s in "fb")[1:]
        for s in "fb":
            g[f"w{s}"], g[f"c{s}"] = x.T @ d_gates[s], d_gates[s].sum(axis=0)
        self.step += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.s[k] += 0.01 * (d * d - self.s[k])
            self.net.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.s[k] / (1 - 0.99**self.step)) + 1e-6)
        np.subtract.at(self.net.p["word"], some.word, 2 * d_x[:, FIXED : FIXED + WORD_DIM])
        np.subtract.at(self.net.p["gram"], some.gram, np.repeat(2 * d_x[:, FIXED + WORD_DIM :] / np.maximum(some.count, 1)[:, None], some.count, axis=0))


def count_prior(rows: list[np.ndarray], features: Features, labels: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Log-odds of label 1 for each word bucket and gram bucket by the texts it is in, drawn to 0 where those are few."""
    seen, starts = np.zeros((2, 2, BUCKETS)), features.starts()
    for met, label in zip(rows, labels):
        met = np.unique(met) - 1
        seen[0, int(label)][np.unique(features.word[met])] += 1
        at = np.repeat(starts[met] - np.concatenate(([0], np.cumsum(features.count[met])[:-1]))[: len(met)], features.count[met]) + np.arange(features.count[met].sum())
        seen[1, int(label)][np.unique(features.gram[at])] += 1
    share = min(max(float(np.mean(labels)), 0.01), 0.99)
    return np.clip(np.log((seen[:, 1] + weight * share) / (seen[:, 0] + weight * (1 - share)) * (1 - share) / share), -2, 4)


def train(texts: list[str], labels: np.ndarray, steps: int = 400, batch: int = 128, seed: int = 7) -> Network:
    """Fit on whole texts in about ``steps`` batches: in each round the highest window of every text, and another one of a text with label 0,
    are learned from."""
    rng, words = np.random.default_rng(seed), Words()
    rows = [words.of(words_of(t)) for t in texts]
    features = Features(words.fresh)
    net = Network(count_prior(rows, features, labels), seed)
    pieces = [windows_of(r) for r in rows]
    flat, owner = np.concatenate(pieces), np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
    first = np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1]))
    trainer = Trainer(net, words.fresh)
    pad = np.zeros((1, FIXED + WORD_DIM + GRAM_DIM), np.float32)
    odds = np.concatenate((pad, net.inputs(features)))[:, :2].sum(axis=1)
    score = odds[flat].max(axis=1)  # before the first round: the window with the word of the highest odds
    for turn in range(max(2, steps * batch // max(1, len(texts) + int((labels == 0).sum())))):
        if turn:
            gates = net.project(np.concatenate((pad, net.inputs(features))))
            score = np.concatenate([net.forward(gates, flat[i : i + 4096]) for i in range(0, len(flat), 4096)])
        top = np.lexsort((-score, owner))[first]
        calm = np.flatnonzero(labels == 0)
        other = first[calm] + rng.integers(0, np.array([len(pieces[i]) for i in calm]))
        chosen = rng.permutation(np.concatenate([top, other]))
        for at in range(0, len(chosen), batch):
            some = chosen[at : at + batch]
            trainer.fit(flat[some], labels[owner[some]].astype(np.float32))
    return net


class Scorer:
    """Scores texts with a fitted network; remembers up to ``most`` words and their gate shares."""

    def __init__(self, net: Network, most: int = 200_000) -> None:
        self.net, self.most = net, most
        self._reset()

    def _reset(self) -> None:
        self.words, self.used = Words(), dict.fromkeys("fb", 1)
        self.gates = {s: np.zeros((1024, 3 * STATE), np.float32) for s in "fb"}

    def _store(self, s: str, rows: np.ndarray) -> None:
        end = self.used[s] + len(rows)
        if end > len(self.gates[s]):
            self.gates[s] = np.concatenate([self.gates[s][: self.used[s]], np.zeros((end, 3 * STATE), np.float32)])
        self.gates[s][self.used[s] : end] = rows
        self.used[s] = end

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words.rows) > self.most:
            self._reset()
        rows = [self.words.of(words_of(t)) for t in texts]
        if self.words.fresh:
            made = self.net.project(self.net.inputs(Features(self.words.fresh)))
            self.words.fresh = []
            for s in "fb":
                self._store(s, made[s])
        pieces = [windows_of(r) for r in rows]
        flat = np.concatenate(pieces)
        out = np.concatenate([self.net.forward(self.gates, flat[i : i + 2048]) for i in range(0, len(flat), 2048)])
        first = np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1]))
        return _sigmoid(np.maximum.reduceat(out, first).astype(np.float64))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = 1500, negatives: int = 3000, longest: int = 12_000) -> Network | None:
    """Fit on labelled rows that are not held out: those of each label that come first by a hash of the id, at most so many, of texts
    up to ``longest`` characters. Several labels of one id count as their highest, and several texts as the one that sorts first. None when a
    label has no row."""
    marked = labels.where(~held_out(doc_id) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    drawn = [marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(n) for k, n in ((1, positives), (0, negatives))]
    sample = drawn[0].unionByName(drawn[1])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= longest).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    got = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0], r[1]))
    marks = np.array([r[2] for r in got], np.int64)
    if not len(got) or marks.min() == marks.max():
        return None
    return train([r[1] for r in got], marks)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, chunk: int = 400_000) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    All overlapping windows of the whole text are scored. Null and empty texts get the score of a text without words. Without rows of both
    labels to learn from, all score 0. Rows keep their ids; repeated rows repeat.
    """
    net = learn(docs, labels, doc_id, text, label)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            texts, scores, some, size = batch.column(2).to_pylist(), [], [], 0
            for i, value in enumerate(texts):
                some.append(value)
                size += len(value or "")
                if size >= chunk or i == len(texts) - 1:
                    scores.append(scorer.score(some) if scorer else np.zeros(len(some)))
                    some, size = [], 0
            made = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made), pa.array((made >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
