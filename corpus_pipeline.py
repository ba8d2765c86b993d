"""Corpus pipeline: documents -> good, distinct, secret-free, mixed, packed.

``STAGES`` lists (name, function) pairs.  Each function takes (spark, docs,
sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
all but the last return the columns of ``docs``.  Null texts and ids, repeated
rows and empty tables follow the operators' docstrings.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from affinity.llm import best_fit_packing, mixing, quality_ranking, secret_scan, simhash_trie
from affinity.llm.common import cut, importable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; trained on labelled rows of its input."""
    return quality_ranking.keep_good(docs, quality_ranking.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash_trie.keep_one(docs, shingle=4, max_bits=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by placeholders."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the tempered source, language and form shares."""
    return mixing.sample(docs).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return best_fit_packing.pack(docs, with_ids=True)


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _stage(fn)) for name, fn in (
    ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets),
    ("mixing", mixture), ("packing", packing))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Tokens, fingerprints and the trained model have no SQL form.
ORACLE_SQL = None
