"""Corpus pipeline: quality filter, near duplicates, source mixture, token identifiers.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
result is written to the shared folder and read again.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm import bpe_stream, fm_quality, jaccard_join, mixing_fill
from quillweave.llm.common import keep, table, tokenizer_file

#: documents that score below go
QUALITY = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones, doesn't reject."""
    machine = fm_quality.fit(docs, table(spark, sf_dir, "labels"))
    return fm_quality.good(docs, machine, threshold=QUALITY)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8."""
    return jaccard_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, at most three times."""
    return mixing_fill.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian) and the digest of the decoded text."""
    coded = bpe_stream.encode_decode(docs, tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mixed_sources),
    ("BPE codec", encoded),
]

#: a fitted model and a tokenizer are not SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
