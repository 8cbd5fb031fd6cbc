"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Distinct marked words are sorted, which lays their trie out in depth-first order: going from one word to the next keeps the forward scores of their
common prefix and computes only those beyond it.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_parts
from .tokencount import MODEL, pre_tokens
from .unigram import Vocabulary, load


def shared_prefixes(words: list[str], most: int = 32) -> list[int]:
    """How many characters, up to ``most``, each of some words shares with the one before."""
    if not words:
        return []
    size = np.array([len(w) for w in words])
    width = max(1, min(most, int(size.max())))
    codes = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
    same = np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1).sum(axis=1)
    return [0, *np.minimum(same, np.minimum(size[1:], size[:-1])).tolist()]


def segment_sorted(words: list[str], vocabulary: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """Each of the sorted words with its best pieces, as packed 32-bit ids. Ties go to the piece that begins first."""
    tail, packed = vocabulary.tails.get, vocabulary.packed
    best, came = [0.0], [0]
    for word, shared in zip(words, shared_prefixes(words)):
        del best[shared + 1 :], came[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, start = -math.inf, end
            for begin in range(end - 1, -1, -1):
                gain = tail(word[begin:end], 0)
                if gain:
                    gain += best[begin]
                    if gain >= top:
                        top, start = gain, begin
                elif gain == 0:  # no piece ends like this, nor like anything longer
                    break
            if start == end:
                top, start = best[end - 1] + vocabulary.fallback(word[end - 1])[0], end - 1
            best.append(top)
            came.append(start)
        found, end = [], len(word)
        while end:
            start = came[end]
            piece = word[start:end]
            found.append(packed[piece] if piece in packed else array("i", vocabulary.fallback(piece)[1]).tobytes())
            end = start
        found.reverse()
        yield word, b"".join(found)


class Encoder:
    """Encodes texts one after the other, and remembers up to ``most`` words."""

    def __init__(self, vocabulary: Vocabulary, most: int = 100_000) -> None:
        self.vocabulary, self.most, self.known = vocabulary, most, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. New words of all the texts are sorted together."""
        units = [pre_tokens(t) for t in texts]
        new = set().union(*units).difference(self.known)
        self.known.update(segment_sorted(sorted(new), self.vocabulary))
        out = [b"".join(map(self.known.__getitem__, u)) for u in units]
        if len(self.known) > self.most:
            self.known = {}
        return out


def decode_ids(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text of a row of ids; what encode made comes back exactly. Ids the model lacks raise."""
    return b"".join(map(vocabulary.raw.__getitem__, ids)).decode(errors="replace")[1:]


class Decoder:
    """Decodes many ids at once: the bytes of all pieces lie in one row, from which those of the ids are gathered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.size = np.array([len(r) for r in vocabulary.raw], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.bytes = np.frombuffer(b"".join(vocabulary.raw), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, verify: bool = True, chunk: int = 500_000) -> DataFrame:
    """Per row: doc_id, n_pieces, ids, and with ``verify`` exact (decoding the ids gives the text back).

    Null texts have null ids; the empty text is the word mark alone. All characters come through: blanks are marks, line
    breaks and characters the model lacks are bytes. Nothing is shuffled; a task remembers a bounded number of words.
    """
    vocabulary = load(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            for part in text_parts(batch, 1, chunk):  # some texts at a time
                texts = part.column(1).to_pylist()
                packed = encoder.encode([t or "" for t in texts])
                count = np.array([len(p) // 4 if t is not None else 0 for p, t in zip(packed, texts)], np.int32)
                flat = np.frombuffer(b"".join(p for p, t in zip(packed, texts) if t is not None), np.int32)
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                valid = pa.array([t is not None for t in texts], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.compute.invert(valid))
                columns, names = [part.column(0), pa.array([None if t is None else int(c) for t, c in zip(texts, count)], pa.int64()), ids], ["doc_id", "n_pieces", "ids"]
                if verify:
                    exact = [None if t is None else decoder.decode(np.frombuffer(p, np.int32)) == b" " + t.encode() for t, p in zip(texts, packed)]
                    columns, names = [*columns, pa.array(exact, pa.bool_())], [*names, "exact"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema[0].dataType.simpleString()}, n_pieces long, ids array<int>" + ", exact boolean" * verify)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Per row: doc_id and the text of its ids; null ids give null."""
    vocabulary = load(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else decode_ids(v, vocabulary) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", F.col(ids).alias("ids"))
    return rows.mapInArrow(work, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")
