"""A training corpus from raw documents: language ID, exact dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact, language, minhash, sentencepiece
from .common import Scratch, ship
from .language import MARGIN
from .queries import PIECES, table, training_rows

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    ship(spark)
    return language.keep_identified(spark, docs, language.learn(training_rows(docs)), MARGIN)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.drop_exact_duplicates(spark, docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    return minhash.drop_near_duplicates(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text beyond the contamination rule."""
    return decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, verified to decode to its text."""
    return sentencepiece.encode(spark, docs, PIECES)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact),
    ("MinHash near-dedup", drop_near),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: Compression, sketches and subword models have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written, and its table freed when the next one is."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
    return docs
