"""Corpus pipeline over ``documents``, counted as part of the subpackage ``llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``docs`` and only drop rows:

1. quality classifier: rows that the factorisation machine rejects go;
2. exact dedup: of equal texts (A-Z lowered) the row with the largest id stays;
3. n-gram Jaccard join: of each component of near copies the smallest id stays;
4. benchmark decontamination: documents that hold or paraphrase a benchmark item go;
5. SentencePiece: digests of ids, decoded text and source offsets of what is left.

Stage 1 learns from the rows of ``labels`` that op2 may learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import common, decontaminate, exact_dedup, ngram_join, piece_codec, quality
from factloom.sources.staged import drop_folder, own_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that op2's model scores below a half go, null and empty texts like any other.

    Without labelled rows every score is a half and all rows stay; repeated rows fare alike;
    an empty table gives an empty one.
    """
    labels = quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, quality.train(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest id; null and empty texts are one group.

    Null ids are the lowest; of rows that repeat the id, one stays; an empty table gives an empty one.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays, that with the smallest id; rows without words all stay.

    Of rows that repeat the id, one stays; null ids are the lowest; an empty table gives an empty one.
    """
    return ngram_join.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose id has a hit in ``benchmark`` go, repeated ones alike; null and empty texts have none.

    An empty table, of documents or items, drops nothing.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for each row; null texts count as empty, repeated rows and null ids are reported each."""
    return piece_codec.encode_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can't express the trained, latent and merged stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage staged on its way is dropped once its rows are written."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with own_folder(spark) as folder:
            out = stage(spark, docs, sf_dir)
        docs = common.stage(out, f"pipeline-{name.replace(' ', '-')}")
        drop_folder(spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
