"""Documents and text forms built from finished tables, and parsers for stored ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.dates import parse_task_phrase
from colloquy.functions.text import bind, blank_to_null, normalize_task, strip
from colloquy.operators.extract import good_assignee, good_description
from colloquy.packs import ZH, RulePack
from colloquy.plans.hot import TARGET_ROWS, number_rows, spread

PART_ROWS = 10_000


# --- files ------------------------------------------------------------------------------------

def write_transcripts(seg: DataFrame, path: str, fmt: str = "json", buckets: int = 64) -> None:
    """Segments as JSON rows or text lines, in a bounded number of folders."""
    placed = seg.withColumn("bucket", F.pmod(F.hash("meeting_id"), F.lit(buckets)))
    if fmt == "json":
        placed.write.mode("overwrite").partitionBy("bucket").json(path)
    elif fmt == "txt":
        placed.select("bucket", transcript_line().alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


def transcript_line() -> Column:
    return F.format_string("[%.2f - %.2f] %s: %s", F.col("start_time"), F.col("end_time"), F.col("speaker"), F.col("text"))


# --- tasks ---------------------------------------------------------------------------------------

# The export columns in order; the quoted ones are always quoted.
TASK_COLUMNS = (
    "id", "title", "meeting_id", "status", "priority", "due_date", "assignee_id", "assignee_name", "confidence",
    "created_at", "updated_at",
)
QUOTED = ("title", "assignee_name")


def export_tasks(tasks: DataFrame, fmt: str = "csv", status=None, meeting_id=None) -> DataFrame:
    """Lines of a task export: ``csv`` data lines (header: ``TASK_COLUMNS``) or one JSON object per task."""
    if status:
        tasks = tasks.filter(F.col("status") == status)
    if meeting_id:
        tasks = tasks.filter(F.col("meeting_id") == meeting_id)
    cols = [F.col(c) if c in tasks.columns else F.lit(None).cast("string").alias(c) for c in TASK_COLUMNS]
    rows = tasks.select(*cols)
    if fmt == "json":
        return rows.select("id", F.to_json(F.struct(*TASK_COLUMNS), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}).alias("line"))
    if fmt != "csv":
        raise ValueError("supported formats are json and csv")

    def cell(c: str) -> Column:
        if c.endswith(("_at", "_date")):
            value = F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
        else:
            value = F.col(c).cast("string")
        value = F.coalesce(value, F.lit(""))
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')) if c in QUOTED else value

    return rows.select("id", F.concat_ws(",", *[cell(c) for c in TASK_COLUMNS]).alias("line"))


# --- meeting documents -------------------------------------------------------------------------------

def _child_parts(df: DataFrame, order: Sequence[str], fields: Sequence[str], name: str, part_rows: int, target: int) -> DataFrame:
    rows = number_rows(df, ["meeting_id"], order, "_i", target).withColumn("part", F.floor(F.col("_i") / part_rows))
    listed = F.array_sort(F.collect_list(F.struct("_i", F.struct(*fields).alias("v"))))
    return rows.groupBy("meeting_id", "part").agg(F.transform(listed, lambda r: r["v"]).alias(name))


def export_meetings(
    meetings: DataFrame, segments: DataFrame, tasks: DataFrame, comments: DataFrame, part_rows: int = PART_ROWS, target: int = TARGET_ROWS
) -> DataFrame:
    """Nested documents ``(id, part, meeting, segments, tasks, comments)``.

    A document holds at most ``part_rows`` rows of each child; a longer meeting goes on in
    further parts, so nothing is left out and no row grows without bound.
    """
    children = [
        _child_parts(segments, ["seg_no"], ["seg_no", "speaker", "text", "start_time", "end_time"], "segments", part_rows, target),
        _child_parts(tasks, ["id"], ["id", "title", "status", "priority", "due_date"], "tasks", part_rows, target),
        _child_parts(comments, ["id", "content"], ["id", "content"], "comments", part_rows, target),
    ]
    out = meetings.select(F.col("id").alias("meeting_id"), F.lit(0).cast("bigint").alias("part"))
    for c in children:
        out = out.join(c, ["meeting_id", "part"], "full")
    info = meetings.select(F.col("id").alias("meeting_id"), F.struct(*meetings.columns).alias("meeting"))
    return out.join(info, "meeting_id").withColumnRenamed("meeting_id", "id")


def meeting_markdown(docs: DataFrame, titles=("会议导出 - ", "会议信息", "会议摘要", "决策项", "未解决问题", "行动项", "协作记录"), labels=("ID", "状态", "时长")) -> DataFrame:
    """Sectioned text of export documents; ``docs`` may carry ``summary, decisions, open_issues``."""
    none = F.array().cast("array<string>")
    has = set(docs.columns)
    strings = lambda c: F.coalesce(F.col(c), none) if c in has else none
    bullets = lambda arr: F.transform(arr, lambda v: F.concat(F.lit("- "), v))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tasks = F.coalesce(F.transform("tasks", lambda v: F.concat(F.lit("- ["), text(v["status"]), F.lit("] "), text(v["title"]))), none)
    notes = F.coalesce(F.transform("comments", lambda v: F.concat(F.lit("- "), text(v["content"]))), none)
    m = F.col("meeting")
    info = [F.concat(F.lit(f"- {k}: "), text(m[c])) for k, c in zip(labels, ("id", "status", "duration"), strict=True)]
    head = lambda i: F.array(F.lit(""), F.lit(f"## {titles[i]}"))
    summary = F.coalesce(strip(F.col("summary")), F.lit("")) if "summary" in has else F.lit("")
    lines = F.concat(
        F.array(F.concat(F.lit(f"# {titles[0]}"), text(m["title"]))), head(1), F.array(*info), head(2), F.array(summary),
        head(3), bullets(strings("decisions")), head(4), bullets(strings("open_issues")), head(5), tasks, head(6), notes,
    )
    return docs.select("id", "part", F.array_join(lines, "\n").alias("markdown"))


def meeting_detail(meetings: DataFrame, segments: DataFrame, tasks: DataFrame, comments: DataFrame) -> DataFrame:
    """Meeting rows with counts and spans of their children, each child aggregated before its join."""
    s = segments.groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("segments"), F.max("end_time").alias("length"))
    k = tasks.groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("tasks"), F.min("due_date").alias("first_due"))
    c = comments.groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("comments"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return meetings.join(s, "id", "left").join(k, "id", "left").join(c, "id", "left").select(
        "id", "title", zero("segments"), "length", zero("tasks"), "first_due", zero("comments")
    )


def _item(v: Column, number: Column) -> Column:
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c.cast("string")))
    first = F.concat(number.cast("string"), F.lit(". **"), F.coalesce(v["description"], F.lit("未知任务")), F.lit("**"))
    return F.concat_ws("\n", first, line("   - 负责人: ", v["assignee"]), line("   - 截止日期: ", v["due_date"]))


def report_parts(docs: DataFrame, tasks: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Reports with every task of ``(id, task_id, description, assignee, due_date)``, long ones in parts.

    Part 0 is the report with the first ``part_rows`` items, each later part goes on with
    the list, so no row grows with a meeting's tasks.
    """
    numbered = number_rows(tasks.withColumn("_at", F.col("task_id").cast("double")), ["id"], ["_at", "task_id"], "number")
    item = F.struct("number", "description", "assignee", "due_date")
    parts = numbered.groupBy("id", F.floor(F.col("number") / part_rows).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("action_items"))
    first = meeting_report(docs.join(parts.filter("part = 0").drop("part"), "id", "left")).withColumn("part", F.lit(0).cast("bigint"))
    lines = F.array_join(F.transform("action_items", lambda v: _item(v, v["number"] + 1)), "\n")
    return first.unionByName(parts.filter("part > 0").select("id", lines.alias("report"), "part")).select("id", "part", "report")


def meeting_report(docs: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Report of ``(id, title, date, minutes, participants[], summary, action_items[], key_topics[], decisions[])``.

    Every section once: items numbered with owner and due lines, topics with keywords, decisions.
    """
    if fmt == "json":
        return docs.select("id", F.to_json(F.struct(*docs.columns)).alias("report"))
    if fmt != "markdown":
        raise ValueError(f"unsupported format {fmt}")
    t = lambda c: F.coalesce(c.cast("string"), F.lit("未知"))

    def topic(v: Column) -> Column:
        words = F.when(F.size(v["keywords"]) > 0, F.concat(F.lit("  - 关键词: "), F.array_join(v["keywords"], ", ")))
        return F.concat_ws("\n", F.concat(F.lit("- **"), v["name"], F.lit("**")), words)

    def section(title: str, body: Column) -> Column:
        return F.when(body != "", F.concat(F.lit(f"## {title}\n\n"), body))

    people = F.when(F.size("participants") > 0, F.array_join("participants", ", ")).otherwise(F.lit("未知"))
    head = F.concat(F.lit("# 会议报告: "), F.coalesce("title", F.lit("无标题")), F.lit("\n\n**会议ID**: "), t(F.col("id")))
    info = F.concat(F.lit("## 会议信息\n\n- **日期**: "), t(F.col("date")), F.lit("\n- **时长**: "), t(F.col("minutes")), F.lit("分钟\n- **参与者**: "), people)
    body = F.concat_ws(
        "\n\n", head, info, section("会议摘要", F.coalesce("summary", F.lit(""))),
        section("行动项", F.array_join(F.transform("action_items", lambda v, i: _item(v, i + 1)), "\n")), section("关键主题", F.array_join(F.transform("key_topics", topic), "\n")),
        section("会议决策", F.array_join(F.transform("decisions", lambda v: F.concat(F.lit("- "), v)), "\n")),
    )
    return docs.select("id", body.alias("report"))


def participants(col) -> Column:
    """Comma-separated names to a list; an empty one is unknown."""
    names = F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), ","), strip), lambda v: v != "")
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("未知")))


def pick_summary(insight, meeting, transcript, segments, n: int = 300) -> Column:
    """The first nonblank of: insight, meeting, start of the transcript, start of the segments."""
    return F.coalesce(
        blank_to_null(insight), blank_to_null(meeting), F.substring(blank_to_null(transcript), 1, n),
        F.substring(blank_to_null(segments), 1, n), F.lit(""),
    )


def excerpt(col, n: int = 1500) -> Column:
    c = strip(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))


def segments_ms(seg: DataFrame, part_rows: int = PART_ROWS, target: int = TARGET_ROWS) -> DataFrame:
    """Millisecond documents of a meeting in parts: segments, their joined text, their speakers."""
    ms = seg.withColumn("start_ms", F.col("start_time") * 1000).withColumn("end_ms", F.col("end_time") * 1000)
    parts = _child_parts(ms, ["seg_no"], ["start_ms", "end_ms", "text", "speaker"], "segments", part_rows, target)
    return parts.select(
        "meeting_id", "part", "segments", F.array_join("segments.text", " ").alias("original_text"),
        F.array_sort(F.array_distinct("segments.speaker")).alias("speakers"),
    )


# --- stored JSON ------------------------------------------------------------------------------------------

def parse_topics(col) -> Column:
    """array<struct<name,keywords>> from JSON text: a list of names or a list of objects."""
    c = F.col(col) if isinstance(col, str) else col
    # try_variant_get reads one list whose elements may be either kind
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")

    def topic(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        name = F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(~F.coalesce(text, F.lit("")).startswith("{"), text))
        words = F.coalesce(F.try_variant_get(v, "$.keywords", "array<string>"), F.array().cast("array<string>"))
        return F.struct(strip(F.coalesce(name, F.lit(""))).alias("name"), words.alias("keywords"))

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<variant>")), topic), lambda t: t["name"] != "")


def extract_json(col) -> Column:
    """The JSON text inside a reply: all of it, a fenced block, the outermost object or list, or a repaired form."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    parses = lambda t: (t != "") & F.try_parse_json(t).isNotNull()
    valid = lambda t: bind(t, lambda u: F.when(parses(u), u))
    fenced = F.regexp_extract_all(c, F.lit("(?s)```(?:json)?\\s*(.*?)\\s*```"), F.lit(1))
    in_fence = F.filter(F.transform(fenced, strip), parses)
    fixed = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("'"), F.lit('"')), ",\\s*\\}", "}"), ",\\s*\\]", "]")
    return F.coalesce(
        valid(strip(c)), F.get(in_fence, F.lit(0)), valid(F.regexp_extract(c, "(?s)\\{.*\\}", 0)), valid(F.regexp_extract(c, "(?s)\\[.*\\]", 0)), valid(strip(fixed))
    )


def _text_list(v: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, strip), lambda s: s.isNotNull() & (s != ""))


def validate_summary(df: DataFrame, col: str = "response") -> DataFrame:
    """Stored summary replies with defaults filled in and bad values dropped."""
    df, v = df.withColumn("_v", F.try_parse_json(extract_json(col))), F.col("_v")
    text = lambda p: strip(F.coalesce(F.try_variant_get(v, p, "string"), F.lit("")))
    raw = F.coalesce(F.try_variant_get(v, "$.key_topics", "array<variant>"), F.array().cast("array<variant>"))
    topics = F.transform(raw, lambda t, i: F.struct(
        F.coalesce(F.try_variant_get(t, "$.id", "string"), F.format_string("topic_%d", i + 1)).alias("id"),
        strip(F.coalesce(F.try_variant_get(t, "$.name", "string"), F.lit(""))).alias("name"), _text_list(t, "$.keywords").alias("keywords"),
        F.coalesce(F.try_variant_get(t, "$.confidence", "double"), F.lit(0.8)).alias("confidence"),
    ))
    mood = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(v, "$.sentiment_overall", "double"), F.lit(0.0))))
    return df.select(
        *[c for c in df.columns if c not in (col, "_v")], text("$.summary").alias("summary"), text("$.executive_summary").alias("executive_summary"),
        F.filter(topics, lambda t: t["name"] != "").alias("key_topics"), _text_list(v, "$.decisions").alias("decisions"),
        _text_list(v, "$.open_issues").alias("open_issues"), mood.alias("sentiment_overall"),
        F.coalesce(F.nullif(text("$.summary_type"), F.lit("")), F.lit("abstractive")).alias("summary_type"),
    )


def validate_tasks(df: DataFrame, key: Sequence[str], as_of, col: str = "response", pack: RulePack = ZH) -> DataFrame:
    """Task rows from stored replies, through the same gates as rule-found tasks."""
    df, v = spread(df), F.try_parse_json(extract_json(col))
    items = F.coalesce(F.try_variant_get(v, "$.action_items", "array<variant>"), F.array().cast("array<variant>"))
    rows = df.select(*key, F.posexplode(items).alias("pos", "_v"))
    field = lambda p, kind="string": F.try_variant_get(F.col("_v"), p, kind)
    rows = rows.withColumn("description", normalize_task(F.coalesce(field("$.description"), F.lit("")), pack))
    rows = rows.filter(good_description(F.col("description"), pack))
    rows = rows.withColumn("_who", normalize_task(field("$.assignee"), pack)).withColumn("_due", F.nullif(strip(field("$.due_date")), F.lit("")))
    who, due, level = F.col("_who"), F.col("_due"), F.lower(F.coalesce(field("$.priority"), F.lit("medium")))
    # an offset, if any, is dropped: times here carry none
    local = F.regexp_replace(due, "(Z|[+-]\\d{2}:\\d{2})$", "")
    return rows.select(
        *key, "pos", "description", F.when(good_assignee(who, pack), who).alias("assignee"),
        F.coalesce(local.try_cast("timestamp_ntz"), parse_task_phrase(due, as_of, pack.due_phrases)).alias("due_date"),
        F.when(level.isin("low", "medium", "high"), level).otherwise("medium").alias("priority"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(field("$.confidence", "double"), F.lit(0.8)))).alias("confidence"),
    )
