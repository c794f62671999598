"""Table jobs: replacing, deleting, resetting, updating, retaining, checking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.dates import as_time, days_between, iso_time
from colloquy.functions.text import blank_to_null, restore_marks, strip
from colloquy.operators.segments import merge_adjacent
from colloquy.packs import ZH, RulePack
from colloquy.sources.schemas import TASK_STATUS


def replace_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments after re-processing: all rows of the meetings in ``new`` are replaced."""
    kept = old.join(new.select("meeting_id").distinct(), "meeting_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def replace_extracted(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """Extracted tasks of the meetings in ``new`` are replaced, manual ones stay."""
    extracted = F.col("extracted_from_text").isNotNull()
    redone = new.select("meeting_id").distinct()
    kept = tasks.filter(~extracted).unionByName(tasks.filter(extracted).join(redone, "meeting_id", "left_anti"))
    items = new.withColumn("title", F.substring("description", 1, 80)).withColumn("extracted_from_text", F.col("description"))
    return kept.unionByName(items, allowMissingColumns=True)


def cascade_delete(
    meetings: DataFrame, segments: DataFrame, tasks: DataFrame, comments: DataFrame, ids: DataFrame
) -> dict[str, DataFrame]:
    """Tables without the meetings in ``ids(id)`` and everything that hangs on them."""
    gone = ids.select(F.col("id").cast("bigint").alias("meeting_id")).distinct()
    gone_tasks = tasks.join(gone, "meeting_id", "left_semi").select(F.col("id").alias("task_id"))
    left = comments.join(gone_tasks, "task_id", "left_anti")
    if "meeting_id" in comments.columns:
        left = left.join(gone, "meeting_id", "left_anti")
    return {
        "meetings": meetings.join(gone.withColumnRenamed("meeting_id", "id"), "id", "left_anti"),
        "segments": segments.join(gone, "meeting_id", "left_anti"),
        "tasks": tasks.join(gone, "meeting_id", "left_anti"),
        "comments": left,
    }


def wanted_ids(raw: DataFrame, col: str = "id") -> DataFrame:
    """Distinct whole-number ids; anything else is dropped."""
    return raw.select(F.col(col).try_cast("bigint").alias("id")).filter(F.col("id").isNotNull()).distinct()


def reset_meetings(meetings: DataFrame, uploads: DataFrame, as_of: str) -> DataFrame:
    """Meetings with a new recording ``(id, audio_path, duration)`` lose their old results."""
    new = uploads.select("id", F.col("audio_path").alias("_path"), F.col("duration").alias("_dur"), F.lit(True).alias("_new"))
    j = meetings.join(new, "id", "left")
    fresh = F.coalesce("_new", F.lit(False))
    cleared = ("transcript_raw", "transcript_formatted", "summary", "summary_type", "key_topics")

    def value(c: str) -> Column:
        if c in cleared:
            return F.when(~fresh, F.col(c)).alias(c)
        new_value = {
            "status": F.lit("scheduled"), "audio_path": F.col("_path"), "updated_at": as_time(as_of),
            "duration": F.when(F.col("_dur") > 0, F.col("_dur")).otherwise(F.col("duration")),
        }.get(c)
        return F.col(c) if new_value is None else F.when(fresh, new_value).otherwise(F.col(c)).alias(c)

    return j.select(*[value(c) for c in meetings.columns])


def apply_task_updates(tasks: DataFrame, updates: DataFrame, as_of: str) -> DataFrame:
    """Partial updates ``(id, seq, fields...)``: the latest one per task, null fields keep the old value."""
    fields = [c for c in updates.columns if c not in ("id", "seq")]
    latest = updates.groupBy("id").agg(F.max_by(F.struct(*fields), "seq").alias("_u"))
    j = tasks.join(latest, "id", "left")
    touched, status = F.col("_u").isNotNull(), F.coalesce("_u.status", "status")
    done = F.when(status == "completed", F.coalesce("completed_at", as_time(as_of)))

    def value(c: str) -> Column:
        if c == "completed_at":
            return F.when(touched, done).otherwise(F.col(c)).alias(c)
        if c == "updated_at":
            return F.when(touched, as_time(as_of)).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.col(f"_u.{c}"), F.col(c)).alias(c) if c in fields else F.col(c)

    return j.select(*[value(c) for c in tasks.columns])


def rename_speakers(seg: DataFrame, names: DataFrame) -> DataFrame:
    """New labels ``(speaker, name)``; labels that are not listed stay."""
    return seg.join(names.select("speaker", "name"), "speaker", "left").withColumn("speaker", F.coalesce("name", "speaker")).drop("name")


def retention(states: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Each state with what becomes of it: cleaned, remaining, or error (kept) when its time is unreadable.

    Times are read by ``iso_time``: those with an offset count as instants, others as UTC like ``as_of``.
    """
    old = days_between(as_time(as_of), made := iso_time("created_time")) > days
    return states.withColumn("outcome", F.when(made.isNull(), "error").when(old, "cleaned").otherwise("remaining"))


def quality_report(users: DataFrame, meetings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows per broken rule: ranges, domains, unique names, foreign keys."""
    one = tasks.agg(
        F.count_if(~F.col("confidence").between(0, 1)).alias("confidence_range"),
        F.count_if(~F.col("status").isin(*TASK_STATUS)).alias("status_domain"),
        F.count_if(F.col("meeting_id").isNull()).alias("meeting_required"),
    )
    ranges = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in ("confidence_range", "status_domain", "meeting_required")
    ])))
    twice = users.groupBy("username").count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("username_unique").alias("rule"), "violations")
    lost = tasks.join(meetings.select(F.col("id").alias("meeting_id")), "meeting_id", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("task_meeting_exists").alias("rule"), "violations"
    )
    ownerless = meetings.join(users.select(F.col("id").alias("owner_id")), "owner_id", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("meeting_owner_exists").alias("rule"), "violations"
    )
    return ranges.unionByName(twice).unionByName(lost).unionByName(ownerless)


def meetings_without_tasks(meetings: DataFrame, tasks: DataFrame) -> DataFrame:
    extracted = tasks.filter(F.col("extracted_from_text").isNotNull()).select(F.col("meeting_id").alias("id"))
    return meetings.join(extracted, "id", "left_anti")


def remove_items(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Items that match no selected row, neither by numeric id nor by description."""
    ids = selected.select(F.col("id").try_cast("bigint").alias("id")).filter(F.col("id").isNotNull()).distinct()
    words = selected.select(blank_to_null("description").alias("_d")).filter(F.col("_d").isNotNull()).distinct()
    left = items.join(ids, "id", "left_anti").withColumn("_d", strip(F.coalesce("description", F.lit(""))))
    return left.join(words, "_d", "left_anti").drop("_d")


def workflow_of(workflows: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """The workflow each transcription belongs to."""
    return transcriptions.join(workflows, "transcription_task_id", "inner")


def latest_status(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event per key with the last non-null value of every other field."""
    rest = [c for c in log.columns if c not in key and c not in order]
    at = F.struct(*order)
    return log.groupBy(*key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest], F.max(at).alias("_at"), F.count(F.lit(1)).alias("events")
    ).select(*key, *rest, F.col("_at")[order[0]].alias("last_at"), "events")


TERMINAL = ("completed", "failed", "cancelled")


def status_group(col="status") -> Column:
    """A status by itself, else by the word inside it, else in progress."""
    c = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    exact = ("completed", "failed", "cancelled", "pending", "in_progress")
    out = F.when(c.isin(*exact), c)
    for word in ("completed", "failed", "cancelled", "pending"):
        out = out.when(c.contains(word), F.lit(word))
    return out.otherwise(F.lit("in_progress"))


def workflow_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(status_group().alias("status")).agg(F.count(F.lit(1)).alias("n"))


def progress(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Percent of the steps done per run."""
    return df.groupBy(*key).agg(F.round(F.count_if(F.col("done")) * 100 / F.count(F.lit(1)), 2).alias("percent"))


def metric_summary(metrics: DataFrame, at: str, names: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Samples, span and average, maximum and minimum of each metric (nulls left out)."""
    return metrics.groupBy(*key).agg(
        F.count(F.lit(1)).alias("samples"), (F.max(at) - F.min(at)).alias("span"),
        *[f(c).alias(f"{c}_{n}") for c in names for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))],
    )


def batch_outcome(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transcription_stats(seg: DataFrame) -> DataFrame:
    """Recordings, hours, mean minutes, words and mean confidence of a transcript corpus."""
    per = seg.groupBy("meeting_id").agg(
        F.sum(F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))).alias("_s"),
        F.sum(F.regexp_count("text", F.lit("[^\\s]+"))).alias("_w"), F.sum("confidence").alias("_c"), F.count("confidence").alias("_n"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("transcriptions"), F.round(F.sum("_s") / 3600, 4).alias("hours"), F.round(F.avg("_s") / 60, 4).alias("mean_minutes"),
        F.sum("_w").alias("words"), F.round(F.sum("_c") / F.sum("_n"), 4).alias("mean_confidence"),
    )


def character_error_rate(reference, hypothesis) -> Column:
    r = F.col(reference) if isinstance(reference, str) else reference
    h = F.col(hypothesis) if isinstance(hypothesis, str) else hypothesis
    return F.levenshtein(r, h) / F.greatest(F.length(r), F.lit(1))


def enhance(seg: DataFrame, punctuation: bool = True, duplicates: bool = True, merge: bool = True, gap: float = 1.0, pack: RulePack = ZH) -> DataFrame:
    """Switchable clean-up of segments: end marks, repeated rows, neighbouring rows."""
    if duplicates:
        first = seg.groupBy("meeting_id", "speaker", "text").agg(F.min_by(F.struct(*[c for c in seg.columns if c not in ("meeting_id", "speaker", "text")]), "seg_no").alias("_r"))
        seg = first.select("meeting_id", "speaker", "text", "_r.*")
    if merge:
        seg = merge_adjacent(seg, gap)
    if punctuation:
        seg = seg.withColumn("text", restore_marks(F.array("text"), pack)[0])
    return seg

