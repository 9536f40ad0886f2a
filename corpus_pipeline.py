"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; the last one returns those of the
SentencePiece digest. Rows with null texts count as empty texts in every stage. The near-duplicate stage takes the
fingerprints, anchors and components of the SimHash operator; MinHash keys add candidates, as fingerprints within a
few bits meet hardly any pair of a similarity of 0.8, and whole shingle sets decide (see README). SQL can't express the stages (compression
classifiers, similarity joins, alignments), so ORACLE_SQL is None and tests hold each stage against a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslake.llm import chaining, decontam, near_dedup, quality, spm
from corpuslake.llm.common import materialize, table
from corpuslake.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; it learns from the labelled rows of docs."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of near duplicates."""
    return near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has."""
    return chaining.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return spm.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
