"""A training-corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stylarium.llm import langid, linededup, mixing, neardup, packing
from stylarium.llm.common import documents, scratch, shared_dir
from stylarium.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the learned languages, go (null and empty texts with them).

    Repeated rows are judged alike; an empty table, or one without any labelled language, keeps nothing.
    """
    return langid.keep_identified(docs, vocabulary(PIECE_VOCABULARY))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every row stays, null texts as they are, repeated rows alike."""
    return linededup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: the document of least id of each group stays.

    Texts without words are linked with nothing and stay; of rows of one doc_id the whole group goes or stays.
    """
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its fitted rate says, in expectation; without labels every rate is 1."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.resample(docs, mixing.mix(docs, labels)[0])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; null text is empty, repeated rows are packed one by one, no rows give no pieces."""
    return packing.pack(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # what a stage wrote for itself goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Learned language scores and hashed groups have no SQL form; tests compare with brute force.
ORACLE_SQL = None
