"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language accepts exactly the substrings of that text. A text is parsed greedily into longest matches;
the language that needs the fewest phrases a byte describes it best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .common import held_out, kept, text_parts

UNKNOWN = "und"
CLASSES, BLOCK = 64, 512
CHUNK = 4_000_000  # bytes of text parsed together
_LETTER = regex.compile(r"\p{L}")


def _plain(text: str) -> bytes:
    return text.lower().encode()


def byte_classes(samples: dict[str, bytes]) -> np.ndarray:
    """A class for each byte: 0 is padding, 1 stands for digits and for bytes rare in all samples, 2 for white space."""
    counts = sum((np.bincount(np.frombuffer(s, np.uint8), minlength=256) for s in samples.values()), np.zeros(256, np.int64))
    out = np.ones(256, np.uint8)
    spaces, digits = list(b" \t\n\r\x0b\f"), list(b"0123456789")
    counts[spaces + digits] = 0
    out[spaces] = 2
    for k, byte in enumerate(np.argsort(-counts, kind="stable")[: CLASSES - 3]):
        if counts[byte]:
            out[byte] = 3 + k
    return out


def automaton(sample: np.ndarray) -> np.ndarray:
    """The suffix automaton of a row of classes as a table of moves: from (state, class), twice the next state, plus one where
    the match ends there and a new phrase begins with this class."""
    moves: list[dict[int, int]] = [{}]
    back, longest, last = [-1], [0], 0
    for c in sample.tolist():
        new = len(moves)
        moves.append({})
        back.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = back[at]
        if at >= 0:
            to = moves[at][c]
            if longest[to] == longest[at] + 1:
                back[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                back.append(back[to])
                longest.append(longest[at] + 1)
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = back[at]
                back[to] = back[new] = copy
        last = new
    follow = np.zeros((len(moves), CLASSES), np.int32)
    for state, out in enumerate(moves):
        follow[state, list(out)] = list(out.values())
    # where nothing follows, a phrase ends and the next begins at the root; a class the sample lacks is a phrase of its own
    table = np.where(follow > 0, 2 * follow, 2 * follow[0] + 1)
    table[:, 0] = 2 * np.arange(len(moves))
    return table.astype(np.int32).ravel()


def _fitted(samples: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
    """Some 12 MB a language, kept for the worker's next tasks."""

    def build() -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
        classes = byte_classes(dict(samples))
        return classes, [(lang, automaton(classes[np.frombuffer(s, np.uint8)])) for lang, s in samples]

    return kept(("languages", samples), build)


def phrases(texts: list[bytes], samples: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Phrases of each text under each language. All blocks of all texts advance side by side, a byte at a time; a
    phrase ends at the latest where a block of ``BLOCK`` bytes ends."""
    classes, tables = _fitted(samples)
    n_blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    owner = np.repeat(np.arange(len(texts)), n_blocks)
    lanes = np.zeros((len(owner), BLOCK), np.uint8)
    at = 0
    for text, n in zip(texts, n_blocks):
        lanes[at : at + n].reshape(-1)[: len(text)] = classes[np.frombuffer(text, np.uint8)]
        at += n
    steps = np.ascontiguousarray(lanes.T)
    out = np.zeros((len(tables), len(texts)), np.int64)
    for k, (_, table) in enumerate(tables):
        state, ended = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
        for column in steps:
            state *= CLASSES
            state += column
            state = table.take(state)
            ended += state & 1
            state >>= 1
        out[k] = np.bincount(owner, ended + (state > 0), len(texts)).astype(np.int64)
    return out


def predict(texts: list[str | None], samples: tuple[tuple[str, bytes], ...], chunk: int = CHUNK) -> tuple[list[str], list[float]]:
    """Language and score of each text. The score is the runner-up's share of the phrases of both: 0.5 for a tie, 1 with one language."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if samples and t and _LETTER.search(t)]
    at = 0
    while at < len(known):
        some, size = [], 0
        while at < len(known) and (not some or size < chunk):
            some.append((known[at], _plain(texts[known[at]])))
            size += len(some[-1][1])
            at += 1
        counts = phrases([raw for _, raw in some], samples)
        order = np.argsort(counts, axis=0, kind="stable")
        for j, (i, _) in enumerate(some):
            langs[i] = samples[order[0, j]][0]
            if len(samples) == 1:
                scores[i] = 1.0
            else:
                first, second = counts[order[0, j], j], counts[order[1, j], j]
                scores[i] = float(second / max(first + second, 1))
    return langs, scores


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = 32_768, all_bytes: int = 4_194_304, sample_docs: int = 64, sample_chars: int = 2048) -> tuple[tuple[str, bytes], ...]:
    """Labelled text per language, from rows that are not held out: the ``sample_docs`` ids of each language that come first by
    a hash of the id, in turn up to ``sample_chars`` characters of each, until ``sample_bytes`` are full (``all_bytes`` over all languages). These
    bounds hold for learning only. Of rows that share id and label, one counts. A hot language is cut to its first ids within each
    task, before the shuffle. More labels than ``all_bytes`` have room for, at 256 bytes each, are no languages and raise."""
    drawn = docs.select(F.col(doc_id).alias("doc_id"), F.substring(F.col(text), 1, sample_chars).alias("text"), F.col(lang).alias("lang"))
    drawn = drawn.where(~held_out("doc_id") & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    keys = drawn.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id", F.lit("sample")))
    first = keys.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("place") <= sample_docs)
    by_lang: dict[str, list[tuple[int, str]]] = {}
    with Scratch(docs.sparkSession) as scratch:
        chosen = scratch.save(first.select("doc_id", "lang", "place"))
        if chosen.count() > sample_docs * (all_bytes // 256):
            raise ValueError(f"column {lang} has too many values for a column of languages")
        for r in drawn.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "place").agg(F.min("text").alias("text")).collect():
            by_lang.setdefault(r["lang"], []).append((r["place"], r["text"]))
    each = min(sample_bytes, max(256, all_bytes // max(1, len(by_lang))))
    return tuple((name, b"\n".join(_plain(t) for _, t in sorted(got))[:each]) for name, got in sorted(by_lang.items()))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Whole texts are parsed. Null texts and texts without a letter are ``und`` with score 0, as are all when no row is labelled. Ties go to the
    language that sorts first. Rows keep their ids; repeated rows repeat.
    """
    samples = learn(docs, doc_id, text, lang)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_parts(batch, 2, CHUNK)):
            langs, scores = predict(part.column(2).to_pylist(), samples)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id")).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id {rows}, held_out boolean, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language can be told, with all their columns: ``und`` goes."""
    samples = learn(docs, doc_id, text, lang)
    schema = docs.schema
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_parts(batch, at, CHUNK)):
            langs, _ = predict(part.column(at).to_pylist(), samples)
            yield part.filter(pa.array([name != UNKNOWN for name in langs], pa.bool_()))

    return docs.mapInArrow(work, schema)
