"""Readers for stored tables and the views that map the sample tables onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from colloquy.functions.text import strip
from colloquy.plans.hot import SLICE, TARGET_ROWS, carry, earlier_slices, in_slice, number_rows, slice_keys
from colloquy.sources.schemas import TABLES

AS_OF = "1998-08-01 00:00:00"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with its declared schema, or a sample table as it is on disk."""
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def load_jdbc(
    spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int
) -> DataFrame:
    """A database table read in key ranges, one connection per partition."""
    return (
        spark.read.format("jdbc")
        .option("url", url).option("dbtable", name).option("partitionColumn", key)
        .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
        .load()
    )


def align_schema(df: DataFrame, target: str | T.StructType) -> DataFrame:
    """Additive migration: columns the target has and the frame lacks come in as null."""
    target = T.StructType.fromDDL(target) if isinstance(target, str) else target
    have = set(df.columns)
    kept = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in target]
    extra = [c for c in df.columns if c not in {f.name for f in target}]
    return df.select(*[c.alias(f.name) for c, f in zip(kept, target, strict=True)], *extra)


def _either(df: DataFrame, *names: str) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def normalize_segments(df: DataFrame, mode: str = "alternate", target: int = TARGET_ROWS) -> DataFrame:
    """Flexible segment rows to one shape.

    ``alternate``: a missing speaker becomes SPEAKER_00/01 by position and a missing
    end becomes the start. ``single``: the speaker default is SPEAKER_00, the end 0.
    """
    start = F.coalesce(_either(df, "start", "start_time").cast("double"), F.lit(0.0))
    end = _either(df, "end", "end_time").cast("double")
    speaker = F.nullif(_either(df, "speaker").cast("string"), F.lit(""))
    if mode == "alternate":
        df = number_rows(df, ["meeting_id"], ["seg_no"], "_pos", target)
        # 0 counts as missing on both sides, like an absent value
        end = F.coalesce(F.nullif(end, F.lit(0.0)), start)
        speaker = F.coalesce(speaker, F.format_string("SPEAKER_%02d", F.col("_pos") % 2))
    elif mode == "single":
        end, speaker = F.coalesce(end, F.lit(0.0)), F.coalesce(speaker, F.lit("SPEAKER_00"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.select(
        "meeting_id", "seg_no", speaker.alias("speaker"),
        strip(F.coalesce(_either(df, "text").cast("string"), F.lit(""))).alias("text"),
        start.alias("start_time"), end.alias("end_time"),
        _either(df, "confidence").cast("double").alias("confidence"),
    )


# --- views over the sample tables ----------------------------------------------------------

def segments(spark: SparkSession, folder: str, target: int = TARGET_ROWS) -> DataFrame:
    """Conversation turns with a clock: a turn lasts 0.1 s per character."""
    turns = load(spark, folder, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seg_no"), F.col("role").alias("speaker"), "text",
        F.length("text").cast("bigint").alias("_len"),
    )
    key = ["meeting_id"]
    rows, cut = slice_keys(turns, key, "seg_no", target)
    local = rows.withColumn(
        "_upto", F.sum("_len").over(in_slice(key, "seg_no").rowsBetween(Window.unboundedPreceding, 0))
    )

    def earlier(ends, over):
        return ends.select(*key, SLICE, F.sum("_all").over(earlier_slices(over)).alias("_before"))

    whole = carry(local, key, [F.sum("_len").alias("_all")], earlier, cut)
    upto = F.coalesce("_before", F.lit(0)) + F.col("_upto")
    return whole.select(
        "meeting_id", "seg_no", "speaker", "text",
        ((upto - F.col("_len")) / 10).alias("start_time"), (upto / 10).alias("end_time"),
    )


def timed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as timed segments: user = meeting, type = speaker, value = minutes."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return load(spark, folder, "events").select(
        F.col("user_id").alias("meeting_id"), F.col("event_id").alias("seg_no"),
        F.col("event_type").alias("speaker"), start.alias("start_time"),
        (start + F.col("value") * 60).alias("end_time"),
        ((F.col("event_id") % 10) / 10).alias("confidence"), F.col("props").alias("text"), "ts",
    )


def meetings(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("description"),
        F.col("c_nationkey").cast("bigint").alias("owner_id"), F.col("c_acctbal").alias("duration"),
        F.when(F.col("c_mktsegment") == "BUILDING", "scheduled").when(F.col("c_mktsegment") == "MACHINERY", "archived")
        .otherwise("completed").alias("status"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    plus = lambda n: day + F.make_dt_interval(n.cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    priority = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low")
    )
    return load(spark, folder, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("meeting_id"),
        F.concat(F.lit('Order "'), key.cast("string"), F.lit('"')).alias("title"),
        F.concat(F.lit("Order item "), (key % 100).cast("string")).alias("description"),
        status.alias("status"), priority.alias("priority"), day.alias("created_at"),
        F.when(key % 7 != 0, plus(key % 60)).alias("due_date"),
        F.when(F.col("o_orderstatus") == "F", plus(key % 30 + 1)).alias("completed_at"),
        (F.col("o_custkey") % 25).alias("assignee_id"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).alias("extracted_from_text"),
        ((key % 100) / 100).alias("confidence"), F.col("o_totalprice").alias("amount"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("username")
    )


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as comments on the task (order) they belong to."""
    return load(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("task_id"),
        F.col("l_suppkey").alias("author_id"), F.concat("l_returnflag", "l_linestatus").alias("content"),
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", "text", "lang", "source")


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        F.col("user_id").alias("task_key"), F.col("event_id"), F.col("event_type").alias("status"), "ts",
        F.col("props").alias("payload"), "value",
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """One voice vector per (chunk, label): the mean of the label's embeddings in the chunk, value by value.

    A chunk is 50 vectors, which bounds what comes together here.
    """
    rows = load(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("chunk_id"), "vec_id", F.col("label").cast("bigint").alias("local_speaker"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    grouped = rows.groupBy("chunk_id", "local_speaker").agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "vec"))).alias("_all"), F.min("vec_id").alias("vec_id")
    )
    total = F.aggregate(F.slice("_all.vec", 2, F.size("_all")), F.col("_all.vec")[0], lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    return grouped.select("chunk_id", "local_speaker", F.transform(total, lambda v: v / F.size("_all")).alias("vec"), "vec_id")
