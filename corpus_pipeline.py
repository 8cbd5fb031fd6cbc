"""The corpus pipeline: documents go through five stages, each written as Parquet and read again by the next.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over what the one before kept; all but the last return the columns of
``documents``. Rows with null ids and texts, repeated rows, empty tables and further columns pass as each operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.exactdedup import drop_copies
from millrace.llm.langid import keep_identified
from millrace.llm.mixing import sample_documents
from millrace.llm.nearcopies import keep_one
from millrace.llm.pieces import encode
from millrace.session import shared_dir

ORACLE_SQL = None  # language models, SimHash and pieces are beyond SQL; tests compare the run with brute force


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (null, or without a letter)."""
    return keep_identified(docs)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, keeps the longest as written, then the smallest id."""
    return drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity 0.8 or more over five-word shingles), keeps the row of the smallest id, null last.
    Texts of linked SimHash fingerprints are compared first; an exact prefix filter finds the copies near 0.8 that SimHash would miss."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples down what exceeds the target weights of its source, language and topic."""
    return sample_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, with the check that decoding gives each text back."""
    return encode(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", remove_copies),
    ("simhash_near_dedup", remove_near_copies),
    ("mixing_weights", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
