"""What a Python worker holds while it encodes, and what stages leave behind in it."""

from __future__ import annotations

import gc
import tracemalloc
import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from millrace.llm import common, langid, nearcopies
from millrace.llm.pieces import Encoder
from millrace.llm.tokencount import MODEL
from millrace.llm.unigram import load


def test_encoder_lets_go_of_words():
    """Texts whose words hardly come back: 300,000 different ones do not pile up, and ids are those of a fresh encoder."""
    encoder = Encoder(load(MODEL))
    texts = [" ".join(f"w{k * 2654435761 % 4294967296:x}" for k in range(at, at + 10_000)) for at in range(0, 300_000, 10_000)]
    tracemalloc.start()
    try:
        got = [encoder.encode([t])[0] for t in texts[:-1]]
        del got
        last = encoder.encode([texts[-1]])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 38_000_000
    assert last == Encoder(encoder.vocabulary).encode([texts[-1]])


@pytest.mark.parametrize("later", ["fit", "near copies"])
def test_a_stage_lets_go_of_the_fit_before(later):
    """Tables of some 12 MB a language do not stay in the worker beside what comes next."""
    table = weakref.ref(langid._fitted((("en", b"the words of one language"),))[1][0][1])
    assert langid._fitted((("en", b"the words of one language"),))[1][0][1] is table()
    if later == "fit":
        langid._fitted((("en", b"other words"),))
    else:
        nearcopies._ask(pd.DataFrame({"text": ["a b c d e f"], "row": [0], "grp": 0}), 1)
    gc.collect()
    assert table() is None


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_text_parts(kind):
    """Every row once and in order; a part ends where its texts reach the size."""
    texts = ["abc", None, "", "é" * 5, "x", None, "yz" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, kind)], names=["doc_id", "text"])
    for most in (1, 4, 10, 1000):
        parts = list(common.text_parts(batch, 1, most))
        assert [t for p in parts for t in p.column(1).to_pylist()] == texts and all(len(p) for p in parts)
        sizes = [[len((t or "").encode()) for t in p.column(1).to_pylist()] for p in parts]
        assert all(sum(s) >= most and sum(s[:-1]) < most for s in sizes[:-1])
    assert not list(common.text_parts(batch.slice(0, 0), 1, 4)) and np.sum([len(p) for p in common.text_parts(batch.slice(3), 1, 4)]) == 5
