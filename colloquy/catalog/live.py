"""Queries for the live jobs: the bounded form of each, and a replay of its stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.views import stamp
from colloquy.operators import changes as ch
from colloquy.session import ship
from colloquy.sources import tables as t
from colloquy.streaming import live

FMT = "yyyy-MM-dd HH:mm:ss"


def text_time(*names):
    return [F.date_format(n, FMT).alias(n) for n in names]


def events(spark, d):
    return t.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, d):
    return live.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# --- sessions -----------------------------------------------------------------------------------------

def messages(ev):
    kind, k = F.col("event_type"), F.col("props")
    text = (
        F.when(kind == "signup", F.lit("start: zh")).when(kind == "purchase", F.lit("end:"))
        .when(kind == "error", F.concat(F.lit("stop:"), k)).otherwise(F.concat(F.lit("audio_base64:"), k))
    )
    return ev.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), text.alias("message"))


_SESSIONS = f"""WITH m AS (SELECT user_id AS session_id, ts, event_id, event_type AS kind, props,
  count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM events),
o AS (SELECT *, count(*) FILTER (WHERE kind = 'signup') OVER (PARTITION BY session_id, part ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0
  AND kind IN ('click', 'view') AS chunk FROM m),
s AS (SELECT session_id, min(ts) FILTER (WHERE kind = 'signup') AS started_at, max(ts) FILTER (WHERE kind = 'purchase') AS ended_at,
  count(*) FILTER (WHERE chunk) AS chunks, CAST(coalesce(sum(length(props)) FILTER (WHERE chunk), 0) AS BIGINT) AS encoded_size FROM o GROUP BY session_id, part)
SELECT session_id, 'zh' AS language, {stamp('started_at')} AS started_at, {stamp('ended_at')} AS ended_at, chunks, encoded_size
FROM s WHERE started_at IS NOT NULL AND ended_at IS NOT NULL"""


@query("R01_assemble_sessions", _SESSIONS)
def assemble_sessions(spark, d):
    out = live.assemble_sessions(messages(events(spark, d)))
    return out.select("session_id", "language", *text_time("started_at", "ended_at"), "chunks", "encoded_size")


@query("R01_assemble_sessions_stream", _SESSIONS)
def assemble_sessions_stream(spark, d):
    out = live.run_available(live.stream_sessions(messages(stream(spark, d))))
    return out.select("session_id", "language", *text_time("started_at", "ended_at"), "chunks", "encoded_size")


@query("R01_unknown_commands", f"SELECT user_id AS session_id, {stamp('ts')} AS ts, 'error:unknown_command' AS reply FROM events WHERE event_type = 'error'")
def unknown_commands(spark, d):
    out = live.unknown_commands(messages(events(spark, d)))
    return out.select("session_id", *text_time("ts"), "reply")


# --- utterances -----------------------------------------------------------------------------------------

def talk(ev):
    return ev.select(F.col("user_id").alias("meeting_id"), F.col("event_type").alias("speaker"), "ts", F.col("props").alias("text"))


_TALK = f"""g AS (SELECT user_id AS meeting_id, event_type AS speaker, ts, props, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS nw
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
h AS (SELECT *, sum(nw) OVER (PARTITION BY meeting_id, speaker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM g),
u AS (SELECT meeting_id, speaker, min(ts) AS started, max(ts) + INTERVAL 6 HOURS AS closes, count(*) AS turns, CAST(sum(length(props)) AS BIGINT) AS characters FROM h GROUP BY meeting_id, speaker, part)
SELECT meeting_id, speaker, {stamp('started')} AS started_at, {stamp('closes')} AS closes_at, turns, characters FROM u"""


@query("R02_utterance_sessions", f"WITH {_TALK}")
def utterance_sessions(spark, d):
    out = live.utterance_sessions(talk(events(spark, d)), 6 * 3600.0)
    return out.select("meeting_id", "speaker", *text_time("started_at", "closes_at"), "turns", "characters")


@query("R02_stream_utterances", f"WITH {_TALK} WHERE closes <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE")
def stream_utterances(spark, d):
    out = live.run_available(live.stream_utterances(talk(stream(spark, d)), "6 hours"))
    return out.select("meeting_id", "speaker", *text_time("started_at", "closes_at"), "turns", "characters")


# --- status log -------------------------------------------------------------------------------------------

def log(ev):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise(kind)
    return ev.select(F.col("user_id").alias("task_key"), "event_id", status.alias("status"), "ts", F.col("props").alias("payload"))


_LOG = """log AS (SELECT user_id AS task_key, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status, ts, props AS payload FROM events),
last AS (SELECT task_key, arg_max(status, {'t': ts, 'e': event_id}) AS status, arg_max(payload, {'t': ts, 'e': event_id}) AS payload, max(ts) AS last_at, count(*) AS events FROM log GROUP BY 1)"""


@query("R03_latest_status_stream", f"WITH {_LOG} SELECT task_key, status, payload, {stamp('last_at')} AS last_at, events FROM last")
def latest_status_stream(spark, d):
    out = live.run_states(live.stream_latest(log(live.replay(events(spark, d)))))
    return out.select("task_key", "status", "payload", *text_time("last_at"), "events")


# the watermark is ten minutes behind the last event when the log has been read
@query("R04_expire_stream", f"""WITH {_LOG} SELECT task_key, status, payload, {stamp('last_at')} AS last_at, floor(epoch_us(last_at) / 1000) + 3600000 *
  CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN 24 ELSE 48 END > (SELECT floor(epoch_us(max(ts)) / 1000) - 600000 FROM events) AS alive FROM last""")
def expire_stream(spark, d):
    ship(spark)
    out = live.run_states(live.stream_states(log(live.replay(events(spark, d)))))
    return out.select("task_key", "status", "payload", *text_time("last_at"), "alive")


@query("R04_expire", f"""WITH {_LOG} SELECT task_key, status, {stamp('last_at')} AS last_at FROM last
WHERE last_at + CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN INTERVAL 24 HOURS ELSE INTERVAL 48 HOURS END > TIMESTAMP '2024-01-31 00:00:00'""")
def expire(spark, d):
    states = ch.latest_status(log(events(spark, d)), ["task_key"], ["ts", "event_id"])
    return live.expire(states, "2024-01-31 00:00:00").select("task_key", "status", *text_time("last_at"))


@query("R05_terminal_events", f"WITH {_LOG} SELECT DISTINCT task_key, status FROM log WHERE status IN ('completed', 'failed', 'cancelled')")
def terminal_events(spark, d):
    return live.terminal_events(log(events(spark, d)))


@query("R05_terminal_events_stream", f"WITH {_LOG} SELECT DISTINCT task_key, status FROM log WHERE status IN ('completed', 'failed', 'cancelled')")
def terminal_events_stream(spark, d):
    return live.run_available(live.terminal_events(log(stream(spark, d))))


# --- windows -------------------------------------------------------------------------------------------------

_HOUR = f"""SELECT {stamp("date_trunc('hour', ts)")} AS window_start, event_type, count(*) AS n, round(avg(value), 9) AS average, max(value) AS peak
FROM events {{}} GROUP BY date_trunc('hour', ts), event_type"""


def shown(out):
    return out.select(*text_time("window_start"), "event_type", "n", F.round("average", 9).alias("average"), "peak")


@query("R06_metric_windows", _HOUR.format(""))
def metric_windows(spark, d):
    return shown(live.metric_windows(events(spark, d)))


@query("R06_metric_windows_stream", _HOUR.format("WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"))
def metric_windows_stream(spark, d):
    return shown(live.run_available(live.metric_windows(stream(spark, d))))


@query("R06_sliding_windows", f"""
SELECT {stamp('w')} AS window_start, event_type, count(*) AS n, round(avg(value), 9) AS average, max(value) AS peak FROM (
  SELECT *, time_bucket(INTERVAL 30 MINUTES, ts) - to_minutes(CAST(30 * o AS BIGINT)) AS w FROM events, (VALUES (0), (1)) v(o)) GROUP BY w, event_type""")
def sliding_windows(spark, d):
    return shown(live.metric_windows(events(spark, d), "1 hour", "30 minutes"))


# --- workflow ---------------------------------------------------------------------------------------------------

_STAGES = f"""WITH w AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN {{'id': event_id, 'ts': ts}} END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT user_id AS task_key, f.id AS first_id, event_id AS second_id, {stamp('f.ts')} AS first_at, {stamp('ts')} AS second_at
FROM w WHERE event_type = 'purchase' AND ts <= f.ts + INTERVAL 8 HOURS"""


def _stages(ev, join):
    first, second = (log(ev.filter(F.col("event_type") == kind)) for kind in ("signup", "purchase"))
    return join(first, second, 8 * 3600)


@query("R07_stage_join", _STAGES)
def stage_join(spark, d):
    out = _stages(events(spark, d), live.stage_join)
    return out.select("task_key", "first_id", "second_id", *text_time("first_at", "second_at"))


@query("R07_stage_join_stream", _STAGES)
def stage_join_stream(spark, d):
    out = live.run_available(_stages(stream(spark, d), live.stream_stage_join))
    return out.select("task_key", "first_id", "second_id", *text_time("first_at", "second_at"))
