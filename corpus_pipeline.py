"""Corpus preparation: five stages from raw documents to packed sequences.

Each stage is one operator over all that the stage before kept, read again from
Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import cotraining, decontaminate, jaccard, line_labels, packing
from colloquy.llm.support import settle
from colloquy.session import ship

TOKENIZER = "word_bpe_49k.json"
#: near copies share 0.8 of their five-word shingles; op4's three words and 0.9 are that query's own
COPY_WORDS, COPY_THRESHOLD = 5, (80, 100)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and whose lines are content."""
    return line_labels.keep_content(docs, _table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return cotraining.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.drop_near_copies(docs, COPY_WORDS, COPY_THRESHOLD)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids; one row per piece of a document."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _stage(fn):
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("quality classifier", _stage(quality_classifier)),
    ("near copies", _stage(near_copies)),
    ("decontamination", _stage(decontamination)),
    ("packing", _stage(pack)),
]

#: fitted models and a tokenizer have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table of documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
