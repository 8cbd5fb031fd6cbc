"""The pipeline, stage by stage, against plain definitions."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from conftest import SF_DIR
from test_operators import DOCS, ROWS, smallest


def plain_stages(rows):
    """(doc_id, text) that each of the first three stages keeps."""
    named = [r for r in rows if r[1] and regex.search(r"\p{L}", r[1])]
    groups = {}
    for r in named:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    single = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    sets = [shingles_of(t) for _, t in single]
    root = smallest(range(len(single)), [(a, b) for a, b in combinations(range(len(single)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    first = {}
    for i, r in enumerate(single):
        first[root[i]] = min(first.get(root[i], (True, 0, i)), (r[0] is None, r[0] or 0, i))
    return [named, single, [single[i] for _, _, i in first.values()]]


def shingles_of(text):
    """Five-word shingles; near copies have a Jaccard similarity of 0.8 or more."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("given", ["small", "edge", "empty"])
def test_stages(spark, tmp_path, given):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet") if given == "small" else spark.createDataFrame(ROWS, DOCS)
    docs = docs.where("doc_id < 0") if given == "empty" else docs
    want = plain_stages([(r["doc_id"], r["text"]) for r in docs.collect()])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 3:
            assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted(want[k], key=repr)
        if k < 4:
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
    assert docs.count() == before.count() and docs.where("not exact").count() == 0


def test_run_is_registered(spark):
    rows = driver.queries()["pipeline"](spark, SF_DIR)
    assert 0 < rows.count() <= 200 and rows.where(F.col("n_pieces") != F.size("ids")).count() == 0
    names = [q for q in driver.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
