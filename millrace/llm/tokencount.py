"""Token counts by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unigram import Vocabulary, load

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNITS = re.compile(r" [^ \n]*|\n|[^ \n]+")


def pre_tokens(text: str) -> list[str]:
    """Words with the blank before them, line breaks alone, and what follows a line break; together they are a blank and the text."""
    return _UNITS.findall(" " + text)


class CountTrie:
    """Distinct pre-tokens in a trie whose nodes hold the best forward score and its number of tokens.

    A prefix that words share is scored once, when its node is made; the node where a word ends thus holds the word's count. Ties in
    score go to fewer tokens. Beyond ``nodes`` nodes the trie starts anew, and words longer than ``deep`` are scored along a row
    without nodes; neither changes a count.
    """

    def __init__(self, vocabulary: Vocabulary, nodes: int = 400_000, deep: int = 64) -> None:
        self.vocabulary, self.most, self.deep = vocabulary, nodes, deep
        self.counts: dict[str, int] = {}
        self._plant()

    def _plant(self) -> None:
        self.root: tuple = ({}, 0.0, 0)  # what follows, score and tokens of the prefix
        self.size = 1

    def _forward(self, word: str, end: int, scores: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score and tokens of the first ``end`` characters, from those of all shorter prefixes."""
        tail, top, least = self.vocabulary.tails.get, -math.inf, 0
        for begin in range(end - 1, -1, -1):
            gain = tail(word[begin:end], 0)
            if gain:
                gain += scores[begin]
                if gain > top or gain == top and tokens[begin] + 1 < least:
                    top, least = gain, tokens[begin] + 1
            elif gain == 0:  # no piece ends like this, nor like anything longer
                break
        if not least:
            gain, spelled = self.vocabulary.fallback(word[end - 1])
            return scores[end - 1] + gain, tokens[end - 1] + len(spelled)
        return top, least

    def insert(self, word: str) -> int:
        scores, tokens = [0.0], [0]
        if len(word) > self.deep:
            for end in range(1, len(word) + 1):
                score, n = self._forward(word, end, scores, tokens)
                scores.append(score)
                tokens.append(n)
            return tokens[-1]
        if self.size > self.most:
            self._plant()
        node = self.root
        for end, char in enumerate(word, 1):
            after = node[0].get(char)
            if after is None:
                after = node[0][char] = ({}, *self._forward(word, end, scores, tokens))
                self.size += 1
            node = after
            scores.append(node[1])
            tokens.append(node[2])
        return node[2]

    def count(self, words: list[str]) -> int:
        new = set(words).difference(self.counts)
        if new:
            for word in sorted(new):
                self.counts[word] = self.insert(word)
        total = sum(map(self.counts.__getitem__, words))
        if len(self.counts) > self.most:
            self.counts = {}
        return total


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, nodes: int = 400_000) -> DataFrame:
    """Per row: doc_id, n_pre_tokens, n_tokens.

    The tokens of the best segmentation of each pre-token under the unigram model of ``model``'s pieces, with bytes for
    characters it lacks. Null and empty texts have none. Nothing is shuffled; each task keeps its own trie.
    """
    vocabulary = load(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountTrie(vocabulary, nodes)
        for batch in batches:
            words, tokens = [], []
            for value in batch.column(1):
                units = pre_tokens(value.as_py()) if value.is_valid and len(value.as_buffer()) else []
                words.append(len(units))
                tokens.append(trie.count(units))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pre_tokens", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema[0].dataType.simpleString()}, n_pre_tokens long, n_tokens long")
