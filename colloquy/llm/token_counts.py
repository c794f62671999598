"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, count). Contents
are joined with it by digest, only distinct contents without a stored count are
encoded, and their counts are appended, so the next run over the same texts encodes
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import shared_folder, slabs
from colloquy.llm.tokens import codec, file_digest

CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


def content(text: Column) -> Column:
    """Normalised content: null is the empty text."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts, one row per digest pair; a path without files is an empty cache."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path).dropDuplicates(["content_digest", "tokenizer_digest"])


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            counts = [len(x) // 4 for x in codec(tokenizer).encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """(doc_id, content_digest, n_bytes, n_tokens) of every row of (doc_id, text).

    ``cache`` is the folder of the cache, in storage that all executors see; without
    it the run has a new one. Null text is the empty text with 0 tokens, a null doc_id
    is carried through, repeated rows and equal texts are encoded once and all
    returned, other columns are ignored, an empty table gives no rows.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer)
    cache = cache or shared_folder(spark, "token-cache")
    text = content(F.col("text"))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("content_digest"))
    stored = read_cache(spark, cache).where(F.col("tokenizer_digest") == version)
    # copies of a content are combined before the shuffle; what the cache lacks is encoded once
    distinct = keyed.groupBy("content_digest").agg(F.first("text").alias("text"))
    new = distinct.join(stored, "content_digest", "left_anti").select("content_digest", "text")
    new = new.mapInArrow(_encode(tokenizer), "content_digest string, n_tokens long")
    new.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    return keyed.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")).join(stored, "content_digest").select(
        "doc_id", "content_digest", "n_bytes", "n_tokens"
    )
