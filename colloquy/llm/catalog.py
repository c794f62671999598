"""Named queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    centroids, cotraining, decontaminate, jaccard, language_model, licenses, line_labels, packing, periodic, token_counts, url_filter, warc, whitening,
)
from colloquy.llm.support import shared_folder
from colloquy.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = "word_bpe_49k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), end_id=2, capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, hits = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform(hits["items"], lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), decontaminate.contaminated(hits).alias("contaminated"),
    )


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, lines = line_labels.judge_lines(docs, line_labels.train(docs, table(spark, sf_dir, "labels")))
    counts = [lines[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, line_labels.base_failed(lines).alias("base_failed"), line_labels.kept(lines).alias("kept"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored, quality = cotraining.score(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))
    columns = [quality[x].alias(x) for x in ("text_probability", "meta_probability", "probability")]
    return scored.select("doc_id", *columns, cotraining.accepted(quality).alias("accepted"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link_documents(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path).where("reason is null")
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to")
    )


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "tokens")


@query
def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def key_crc(key: str) -> Column:
    """crc32 of the decimal key; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(key_crc("doc_id") % 4 == 2, F.lit(False))
    model = centroids.learn(docs.where(~held_out), order=F.xxhash64("doc_id", "text"))
    found, language = centroids.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out.alias("held_out"), language["lang"].alias("lang_pred"), language["score"].alias("score"),
        language["cluster"].alias("cluster"), language["rejected"].alias("rejected"),
    )


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitener(vectors)
    rows, white = whitening.whiten(vectors, model)
    shares = F.array(*[F.lit(x).cast("double") for x in model.explained])
    parts = rows.select("vec_id", white["deviation"].alias("deviation"), F.posexplode(white["whitened"]).alias("place", "whitened"))
    return parts.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, "place").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text); in every tenth document by crc32 of its id, the words from one place on repeat with one period."""
    h = key_crc("doc_id")
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"), g.alias("g")).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, a).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = periodic.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    runs, longest = found["runs"], periodic.longest(found["runs"])
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return rows.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), longest["start"].alias("start"), longest["length"].alias("length"), longest["period"].alias("period"),
        F.floor(1000 * longest["length"] / longest["period"]).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(found["collapsed"], 256).alias("collapsed_sha256"),
    )
