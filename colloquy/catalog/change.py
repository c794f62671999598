"""Queries for the table jobs, state logs and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.speech import _W01, sql_strip
from colloquy.catalog.views import COMMENTS, EVENTS, MEETINGS, SEGMENTS, TASKS, USERS, stamp, with_
from colloquy.functions.text import word_errors
from colloquy.operators import changes as ch
from colloquy.packs import PROSE
from colloquy.sources import tables as t

NOW = t.AS_OF
FMT = "yyyy-MM-dd HH:mm:ss"


def text_time(*names):
    return [F.date_format(n, FMT).alias(n) for n in names]


@query("S02_align_schema", with_(MEETINGS) + """
SELECT id, title, CAST(NULL AS INTEGER) AS participants, CAST(NULL AS VARCHAR) AS assignee_name, owner_id FROM meetings""")
def align_schema(spark, d):
    out = t.align_schema(t.meetings(spark, d), "id bigint, title string, participants int, assignee_name string, owner_id bigint")
    return out.select("id", "title", "participants", "assignee_name", "owner_id")


_REDONE = "SELECT conv_id AS meeting_id, 0 AS seg_no, string_agg(role, ',' ORDER BY turn) AS text FROM conversations GROUP BY 1 HAVING count(*) > 5"


@query("D01_replace_segments", with_(SEGMENTS) + f"""
, n AS ({_REDONE}) SELECT meeting_id, seg_no, text FROM segments WHERE meeting_id NOT IN (SELECT meeting_id FROM n) UNION ALL SELECT * FROM n""")
def replace_segments(spark, d):
    old = t.segments(spark, d).select("meeting_id", "seg_no", "text")
    turns = t.load(spark, d, "conversations").groupBy(F.col("conv_id").alias("meeting_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]), ",").alias("text"), F.count(F.lit(1)).alias("n")
    )
    new = turns.filter(F.col("n") > 5).select("meeting_id", F.lit(0).cast("bigint").alias("seg_no"), "text")
    return ch.replace_segments(old, new)


_NEW = "SELECT c_custkey AS meeting_id, 'Call ' || c_name || ' about ' || c_mktsegment || ' and the open points of the last talk about the prices' AS description FROM customer WHERE c_acctbal > 5000"


@query("D02_J09_replace_extracted", with_(TASKS) + f"""
, n AS ({_NEW}) SELECT meeting_id, title, description, extracted_from_text FROM tasks
WHERE extracted_from_text IS NULL OR meeting_id NOT IN (SELECT meeting_id FROM n)
UNION ALL SELECT meeting_id, substr(description, 1, 80), description, description FROM n""")
def replace_extracted(spark, d):
    about = F.concat(F.lit("Call "), "c_name", F.lit(" about "), "c_mktsegment", F.lit(" and the open points of the last talk about the prices"))
    new = t.load(spark, d, "customer").filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("meeting_id"), about.alias("description"))
    return ch.replace_extracted(t.tasks(spark, d).select("meeting_id", "title", "description", "extracted_from_text"), new)


@query("J09_meetings_without_tasks", with_(TASKS, MEETINGS) + """
SELECT id, title FROM meetings WHERE id NOT IN (SELECT meeting_id FROM tasks WHERE extracted_from_text IS NOT NULL)""")
def meetings_without_tasks(spark, d):
    return ch.meetings_without_tasks(t.meetings(spark, d), t.tasks(spark, d)).select("id", "title")


@query("D03_U05_cascade_delete", with_(TASKS, MEETINGS, COMMENTS, SEGMENTS) + """
, gone AS (SELECT DISTINCT id FROM meetings WHERE duration < 0)
SELECT 'meetings' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM meetings WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'segments', count(*), CAST(sum(meeting_id) AS BIGINT) FROM segments WHERE meeting_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'tasks', count(*), CAST(sum(id) AS BIGINT) FROM tasks WHERE meeting_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'comments', count(*), CAST(sum(id) AS BIGINT) FROM comments
  WHERE task_id NOT IN (SELECT id FROM tasks WHERE meeting_id IN (SELECT id FROM gone))""")
def cascade_delete(spark, d):
    m = t.meetings(spark, d)
    gone = m.filter(F.col("duration") < 0).select(F.col("id").cast("string").alias("id"))
    ids = ch.wanted_ids(gone.unionAll(gone).unionAll(m.select(F.col("title").alias("id"))))
    left = ch.cascade_delete(m, t.segments(spark, d), t.tasks(spark, d), t.comments(spark, d), ids)
    keys = {"meetings": "id", "segments": "meeting_id", "tasks": "id", "comments": "id"}
    parts = [left[n].agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("ids")).select(F.lit(n).alias("name"), "n", "ids") for n, k in keys.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("D04_reset_meetings", with_(MEETINGS) + f"""
, up AS (SELECT s_suppkey * 3 AS id, s_name || '.wav' AS audio_path, s_acctbal AS duration FROM supplier)
SELECT m.id, CASE WHEN up.id IS NULL THEN status ELSE 'scheduled' END AS status, CASE WHEN up.id IS NULL THEN 's' || m.id END AS summary,
  up.audio_path, CASE WHEN up.duration > 0 THEN up.duration ELSE m.duration END AS duration,
  CASE WHEN up.id IS NOT NULL THEN '{NOW}' END AS updated_at FROM meetings m LEFT JOIN up ON up.id = m.id""")
def reset_meetings(spark, d):
    m = t.meetings(spark, d).withColumn("summary", F.concat(F.lit("s"), F.col("id").cast("string")))
    m = m.withColumn("audio_path", F.lit(None).cast("string")).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    up = t.load(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.concat("s_name", F.lit(".wav")).alias("audio_path"), F.col("s_acctbal").alias("duration"))
    return ch.reset_meetings(m, up, NOW).select("id", "status", "summary", "audio_path", "duration", *text_time("updated_at"))


@query("D05_apply_task_updates", with_(TASKS) + f"""
, u AS (SELECT l_orderkey AS id, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'completed' WHEN 'A' THEN 'blocked' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN 'urgent' END AS priority FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1)
SELECT t.id, coalesce(u.status, t.status) AS status, coalesce(u.priority, t.priority) AS priority,
  {stamp(f"CASE WHEN u.id IS NULL THEN completed_at WHEN coalesce(u.status, t.status) = 'completed' THEN coalesce(completed_at, TIMESTAMP '{NOW}') END")} AS completed_at
FROM tasks t LEFT JOIN u ON u.id = t.id""")
def apply_task_updates(spark, d):
    flag, no = F.col("l_returnflag"), F.col("l_linenumber")
    up = t.load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.when(flag == "R", "completed").when(flag == "A", "blocked").alias("status"), F.when(no % 2 == 0, "urgent").alias("priority"),
    )
    return ch.apply_task_updates(t.tasks(spark, d), up, NOW).select("id", "status", "priority", *text_time("completed_at"))


@query("D06_rename_speakers", with_(SEGMENTS) + """
SELECT meeting_id, seg_no, CASE speaker WHEN 'user' THEN 'Guest' WHEN 'assistant' THEN 'Host' ELSE speaker END AS speaker FROM segments""")
def rename_speakers(spark, d):
    names = spark.createDataFrame([("user", "Guest"), ("assistant", "Host")], "speaker string, name string")
    return ch.rename_speakers(t.segments(spark, d), names).select("meeting_id", "seg_no", "speaker")


_STATES = """states AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'soon' WHEN event_id % 13 = 0 THEN NULL
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS created_time, ts FROM events)"""


@query("D07_retention", f"""WITH {_STATES}
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN created_time IS NULL OR created_time = 'soon' THEN 'error'
  WHEN epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(date_trunc('second', ts)) > 7 * 86400 THEN 'cleaned' ELSE 'remaining' END AS outcome FROM states) GROUP BY 1""")
def retention(spark, d):
    e = F.col("event_id")
    made = F.when(e % 11 == 0, "soon").when(e % 13 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    states = t.load(spark, d, "events").withColumn("created_time", made)
    return ch.retention(states, "2024-01-20 00:00:00", 7).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# one shape of a time per event: day, minutes, fractions, zones, and texts that only look like times
_SHAPES = """shapes AS (SELECT event_id, ts, date_trunc('minute', ts) AS m, CASE event_id % 12 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+05:30')
  WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.123456789-1100') WHEN 6 THEN strftime(ts, '%Y-%m-%d_%H:%M-03') WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+24:00')
  WHEN 8 THEN strftime(ts, '%d.%m.%Y') WHEN 9 THEN strftime(ts, '%Y-%m-31T%H') WHEN 10 THEN '' END AS created_time FROM events)"""


@query("D07_retention_iso", f"""WITH {_SHAPES},
read AS (SELECT event_id, created_time, CASE event_id % 12 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN m WHEN 2 THEN ts WHEN 3 THEN date_trunc('second', ts)
  WHEN 4 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 5 THEN date_trunc('second', ts) + INTERVAL 660 MINUTE + INTERVAL 123456 MICROSECOND WHEN 6 THEN m + INTERVAL 180 MINUTE
  WHEN 9 THEN try_cast(strftime(ts, '%Y-%m-31 %H:00:00') AS TIMESTAMP) END AS made FROM shapes)
SELECT event_id, created_time, CASE WHEN made IS NULL THEN 'error' WHEN epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(made) > 7 * 86400000000 THEN 'cleaned' ELSE 'remaining' END AS outcome FROM read""")
def retention_iso(spark, d):
    k, ts = F.col("event_id") % 12, F.col("ts")
    shapes = {
        0: "yyyy-MM-dd", 1: "yyyy-MM-dd'T'HH:mm", 2: "yyyy-MM-dd HH:mm:ss.SSSSSS", 3: "yyyy-MM-dd'T'HH:mm:ss'Z'", 4: "yyyy-MM-dd'T'HH:mm:ss'+05:30'",
        5: "yyyy-MM-dd'T'HH:mm:ss'.123456789-1100'", 6: "yyyy-MM-dd'_'HH:mm'-03'", 7: "yyyy-MM-dd'T'HH:mm:ss'+24:00'", 8: "dd.MM.yyyy", 9: "yyyy-MM'-31T'HH",
    }
    made = F.when(k == 10, "")
    for i, shape in shapes.items():
        made = made.when(k == i, F.date_format(ts, shape))
    states = t.load(spark, d, "events").select("event_id", made.alias("created_time"))
    return ch.retention(states, "2024-01-20 00:00:00", 7).select("event_id", "created_time", "outcome")


@query("D08_quality_report", with_(TASKS, MEETINGS, USERS) + """
, bad AS (SELECT * REPLACE (CASE WHEN id % 50 = 0 THEN 1.5 ELSE confidence END AS confidence, CASE WHEN id % 40 = 0 THEN 'lost' ELSE status END AS status,
  CASE WHEN id % 30 = 0 THEN NULL WHEN id % 31 = 0 THEN -1 ELSE meeting_id END AS meeting_id) FROM tasks)
SELECT 'confidence_range' AS rule, count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1) AS violations FROM bad
UNION ALL SELECT 'status_domain', count(*) FILTER (WHERE status NOT IN ('pending', 'in_progress', 'completed', 'blocked')) FROM bad
UNION ALL SELECT 'meeting_required', count(*) FILTER (WHERE meeting_id IS NULL) FROM bad
UNION ALL SELECT 'username_unique', count(*) FROM (SELECT username FROM users GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'task_meeting_exists', count(*) FROM bad WHERE NOT EXISTS (SELECT 1 FROM meetings m WHERE m.id = bad.meeting_id)
UNION ALL SELECT 'meeting_owner_exists', count(*) FROM meetings WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = owner_id)""")
def quality_report(spark, d):
    i = F.col("id")
    bad = t.tasks(spark, d).withColumn("confidence", F.when(i % 50 == 0, 1.5).otherwise(F.col("confidence")))
    bad = bad.withColumn("status", F.when(i % 40 == 0, "lost").otherwise(F.col("status")))
    bad = bad.withColumn("meeting_id", F.when(i % 30 == 0, None).when(i % 31 == 0, -1).otherwise(F.col("meeting_id")))
    return ch.quality_report(t.users(spark, d), t.meetings(spark, d), bad)


@query("D09_enhance", with_(EVENTS) + """
, u AS (SELECT meeting_id, speaker, text, min(start_time) AS start_time FROM timed GROUP BY ALL)
SELECT meeting_id, speaker, round(start_time, 3) AS start_time,
  CASE WHEN regexp_matches(text, '[。？！；…]$') THEN text WHEN regexp_matches(text, '(wh|que)') THEN text || '？' ELSE text || '。' END AS text FROM u""")
def enhance(spark, d):
    out = ch.enhance(t.timed_events(spark, d).drop("ts"), merge=False, pack=PROSE)
    return out.select("meeting_id", "speaker", F.round("start_time", 3).alias("start_time"), "text")


@query("D09_enhance_merged", with_(EVENTS) + _W01 + """
, u AS (SELECT meeting_id, min(speaker) AS speaker, min(start_time) AS start_time, string_agg(text, ' ' ORDER BY start_time, seg_no) AS text FROM f GROUP BY meeting_id, island)
SELECT meeting_id, speaker, round(start_time, 3) AS start_time,
  CASE WHEN regexp_matches(text, '[。？！；…]$') THEN text WHEN regexp_matches(text, '(wh|que)') THEN text || '？' ELSE text || '。' END AS text FROM u""")
def enhance_merged(spark, d):
    out = ch.enhance(t.timed_events(spark, d).drop("ts"), duplicates=False, gap=3600.0, pack=PROSE)
    return out.select("meeting_id", "speaker", F.round("start_time", 3).alias("start_time"), "text")


@query("J10_workflow_of", """
WITH wf AS (SELECT user_id AS workflow_id, 't' || (user_id * 7) AS transcription_task_id, max(ts) AS at FROM events GROUP BY 1)
SELECT event_id, workflow_id FROM (SELECT event_id, 't' || (event_id % 2000) AS transcription_task_id FROM events) JOIN wf USING (transcription_task_id)""")
def workflow_of(spark, d):
    ev = t.load(spark, d, "events")
    wf = ev.groupBy(F.col("user_id").alias("workflow_id")).agg(F.max("ts").alias("at"))
    wf = wf.withColumn("transcription_task_id", F.concat(F.lit("t"), (F.col("workflow_id") * 7).cast("string")))
    tr = ev.select("event_id", F.concat(F.lit("t"), (F.col("event_id") % 2000).cast("string")).alias("transcription_task_id"))
    return ch.workflow_of(wf, tr).select("event_id", "workflow_id")


@query("U01_concat_parts", with_(EVENTS, SEGMENTS) + """
SELECT part, meeting_id, count(*) AS n FROM (SELECT 'events' AS part, meeting_id, text FROM timed UNION ALL SELECT 'turns', meeting_id, text FROM segments) GROUP BY ALL""")
def concat_parts(spark, d):
    cols = ["part", "meeting_id", "text"]
    a = t.timed_events(spark, d).withColumn("part", F.lit("events")).select(*cols)
    b = t.segments(spark, d).withColumn("part", F.lit("turns")).select(*cols)
    return a.unionByName(b).groupBy("part", "meeting_id").agg(F.count(F.lit(1)).alias("n"))


@query("U06_remove_items", with_(TASKS) + f"""
, sel AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS id, '  Order item ' || (s_suppkey % 40) || ' ' AS description FROM supplier)
SELECT id, description FROM tasks WHERE id NOT IN (SELECT TRY_CAST(id AS BIGINT) FROM sel WHERE TRY_CAST(id AS BIGINT) IS NOT NULL)
  AND description NOT IN (SELECT {sql_strip('description')} FROM sel)""")
def remove_items(spark, d):
    s = F.col("s_suppkey")
    sel = t.load(spark, d, "supplier").select(
        F.when(s % 2 == 0, s.cast("string")).otherwise(F.col("s_name")).alias("id"),
        F.concat(F.lit("  Order item "), (s % 40).cast("string"), F.lit(" ")).alias("description"),
    )
    return ch.remove_items(t.tasks(spark, d).select("id", "description"), sel)


@query("R03_latest_status", f"""
SELECT task_key, arg_max(status, {{'ts': ts, 'e': event_id}}) AS status, arg_max(payload, {{'ts': ts, 'e': event_id}}) AS payload,
  arg_max(value, {{'ts': ts, 'e': event_id}}) FILTER (WHERE value IS NOT NULL) AS value, {stamp('max(ts)')} AS last_at, count(*) AS events
FROM (SELECT user_id AS task_key, event_id, event_type AS status, ts, props AS payload, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events) GROUP BY 1""")
def latest_status(spark, d):
    log = t.status_log(spark, d).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return ch.latest_status(log, ["task_key"], ["ts", "event_id"]).select("task_key", "status", "payload", "value", *text_time("last_at"), "events")


@query("A12_transcription_stats", with_(EVENTS) + """
SELECT count(*) AS transcriptions, round(sum(s) / 3600, 4) AS hours, round(avg(s) / 60, 4) AS mean_minutes, CAST(sum(w) AS BIGINT) AS words,
  round(sum(c) / sum(n), 4) AS mean_confidence FROM (SELECT meeting_id, sum(greatest(0, end_time - start_time)) AS s,
    sum(len(regexp_extract_all(text, '[^\\s]+'))) AS w, sum(confidence) AS c, count(confidence) AS n FROM timed GROUP BY 1)""")
def transcription_stats(spark, d):
    return ch.transcription_stats(t.timed_events(spark, d))


@query("A13_character_error_rate", with_(TASKS) + """
SELECT id, round(levenshtein(title, description) / greatest(length(title), 1), 4) AS cer FROM tasks""")
def character_error_rate(spark, d):
    return t.tasks(spark, d).select("id", F.round(ch.character_error_rate("title", "description"), 4).alias("cer"))


@query("A13_word_error_rate", """
SELECT conv_id, turn, len(w) AS words, len(w) - (len(w) + 2) // 3 + (len(w) + 2) // 3 AS aligned, (len(w) + 2) // 3 AS errors FROM (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda v: v <> '') AS w FROM conversations)""")
def word_error_rate(spark, d):
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    # every third word is replaced by a word no text has
    worse = F.array_join(F.transform(words, lambda w, i: F.when(i % 3 == 0, F.concat(F.lit("#"), i.cast("string"))).otherwise(w)), " ")
    rows = t.load(spark, d, "conversations")
    return rows.select(
        "conv_id", "turn", F.size(words).cast("bigint").alias("words"), F.size(words).cast("bigint").alias("aligned"),
        word_errors("text", worse).alias("errors"),
    )


@query("A13_quality_metrics", with_(EVENTS) + """
SELECT meeting_id, round(avg(confidence), 4) AS mean_confidence, count(*) AS segments, round(sum(end_time - start_time), 2) AS duration FROM timed GROUP BY 1""")
def quality_metrics(spark, d):
    return t.timed_events(spark, d).groupBy("meeting_id").agg(
        F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count(F.lit(1)).alias("segments"), F.round(F.sum(F.col("end_time") - F.col("start_time")), 2).alias("duration")
    )


_ST = "CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'stage_failed_x' WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 2 = 0 THEN 'pending_review' ELSE event_type END END"


@query("A16_workflow_stats", f"""
SELECT CASE WHEN s IN ('completed', 'failed', 'cancelled', 'pending', 'in_progress') THEN s WHEN contains(s, 'completed') THEN 'completed'
  WHEN contains(s, 'failed') THEN 'failed' WHEN contains(s, 'cancelled') THEN 'cancelled' WHEN contains(s, 'pending') THEN 'pending'
  ELSE 'in_progress' END AS status, count(*) AS n FROM (SELECT {_ST} AS s FROM events) GROUP BY 1""")
def workflow_stats(spark, d):
    e = F.col("event_type")
    status = F.when(e == "click", "completed").when(e == "view", "stage_failed_x").when(e == "error", "failed").when(F.col("event_id") % 2 == 0, "pending_review").otherwise(e)
    return ch.workflow_stats(t.load(spark, d, "events").select(status.alias("status")))


_COUNTED = ("nation", "customer", "orders", "lineitem", "events", "documents", "conversations")


@query("A17_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _COUNTED))
def table_counts(spark, d):
    return ch.table_counts({n: t.load(spark, d, n) for n in _COUNTED})


@query("A19_metric_summary", """
SELECT user_id, count(*) AS samples, max(event_id) - min(event_id) AS span, round(avg(value), 9) AS value_avg, max(value) AS value_max, min(value) AS value_min,
  round(avg(gpu), 9) AS gpu_avg, max(gpu) AS gpu_max, min(gpu) AS gpu_min FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN value * 2 END AS gpu FROM events) GROUP BY 1""")
def metric_summary(spark, d):
    m = t.load(spark, d, "events").withColumn("gpu", F.when(F.col("event_id") % 4 == 0, F.col("value") * 2))
    out = ch.metric_summary(m, "event_id", ["value", "gpu"], ["user_id"])
    return out.withColumn("value_avg", F.round("value_avg", 9)).withColumn("gpu_avg", F.round("gpu_avg", 9))


@query("A20_batch_outcome", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def batch_outcome(spark, d):
    return ch.batch_outcome(t.load(spark, d, "events").withColumn("success", F.col("event_type") != "error"), ["user_id"])


@query("R08_progress", "SELECT user_id, round(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) * 100 / count(*), 2) AS percent FROM events GROUP BY 1")
def progress(spark, d):
    return ch.progress(t.load(spark, d, "events").withColumn("done", F.col("event_type").isin("click", "purchase")), ["user_id"])
