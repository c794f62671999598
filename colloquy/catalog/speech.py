"""Queries over timed segments and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.views import EVENTS, MEETINGS, SEGMENTS, with_
from colloquy.functions.text import WS, any_of
from colloquy.operators import segments as ops
from colloquy.packs import PROSE
from colloquy.sources import tables as t

RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
REPEATED = "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyz")


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


NORM = f"lower(regexp_replace(coalesce(text, ''), '(?:{WS}|[，,。.!！？?；;:：\\-])+', '', 'g'))"
LOW = (
    f"(length({NORM}) <= 2 OR {NORM} IN {sql_list(PROSE.fillers)} OR regexp_matches({NORM}, '^[a-z]{{1,4}}$')"
    f" OR regexp_matches({NORM}, '{REPEATED}') OR (length({NORM}) <= 5 AND NOT regexp_matches({NORM}, '{PROSE.script_char}')))"
)
MARKED = f"regexp_matches(text, '{any_of(PROSE.important)}|{PROSE.important_regex}')"


@query("S03_normalize_segments", with_(SEGMENTS) + f"""
SELECT meeting_id, seg_no, CASE WHEN speaker <> 'system' AND seg_no % 3 <> 0 THEN speaker ELSE 'SPEAKER_0' || (pos % 2) END AS speaker,
  {sql_strip('text')} AS text, coalesce(start_time, 0) AS start_time,
  CASE WHEN seg_no % 4 = 1 THEN start_time ELSE end_time END AS end_time
FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) - 1 AS pos FROM segments)""")
def normalize_segments(spark, d):
    seg = t.segments(spark, d)
    raw = seg.select(
        "meeting_id", "seg_no", F.when((F.col("speaker") != "system") & (F.col("seg_no") % 3 != 0), F.col("speaker")).alias("speaker"),
        "text", F.when(F.col("seg_no") % 2 == 0, F.col("start_time")).alias("start"), "start_time",
        F.when(F.col("seg_no") % 4 != 1, F.col("end_time")).alias("end"),
    )
    return t.normalize_segments(raw).drop("confidence")


@query("S03_normalize_single", with_(SEGMENTS) + f"""
SELECT meeting_id, seg_no, CASE WHEN speaker = 'user' THEN 'SPEAKER_00' ELSE speaker END AS speaker, {sql_strip('text')} AS text,
  start_time, CASE WHEN seg_no % 4 = 1 THEN 0.0 ELSE end_time END AS end_time FROM segments""")
def normalize_single(spark, d):
    raw = t.segments(spark, d).withColumn("speaker", F.when(F.col("speaker") != "user", F.col("speaker"))).withColumn(
        "end_time", F.when(F.col("seg_no") % 4 != 1, F.col("end_time"))
    )
    return t.normalize_segments(raw, "single").drop("confidence")


_W01 = """, a AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS nw FROM timed
  WINDOW w AS (PARTITION BY meeting_id ORDER BY start_time, seg_no)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY meeting_id ORDER BY start_time, seg_no) AS run FROM a),
c AS (SELECT *, max(end_time) OVER (PARTITION BY meeting_id, run ORDER BY start_time, seg_no """ + PAST + """) AS reach FROM b),
e AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach + 3600 THEN 1 ELSE 0 END)
  OVER (PARTITION BY meeting_id ORDER BY start_time, seg_no) AS island FROM c),
f AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, island) AS n,
  row_number() OVER (PARTITION BY meeting_id, island ORDER BY start_time DESC, seg_no DESC) AS back FROM e)
"""


@query("W01_merge_adjacent", with_(EVENTS) + _W01 + """
SELECT meeting_id, min(seg_no) AS seg_no, min(speaker) AS speaker, round(min(start_time), 3) AS start_time,
  round(max(end_time), 3) AS end_time, string_agg(text, ' ' ORDER BY start_time, seg_no) AS text,
  round(sum(confidence * CASE WHEN back = n THEN pow(0.5, n - 1) ELSE pow(0.5, back) END), 5) AS confidence, count(*) AS parts
FROM f GROUP BY meeting_id, island""")
def merge_adjacent(spark, d):
    out = ops.merge_adjacent(t.timed_events(spark, d), gap=3600.0)
    return out.select(
        "meeting_id", "seg_no", "speaker", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"),
        "text", F.round("confidence", 5).alias("confidence"), F.col("parts").cast("bigint").alias("parts"),
    )


_W02 = f""", kept AS (SELECT meeting_id, seg_no, speaker, {sql_strip('text')} AS text, start_time, end_time FROM segments WHERE NOT {LOW}),
a AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND start_time - lag(end_time) OVER w <= GAP
  THEN 0 ELSE 1 END AS nw FROM kept WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_no)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY meeting_id ORDER BY seg_no) AS island FROM a),
g AS (SELECT meeting_id, island, min(speaker) AS speaker, count(*) AS turns, min(start_time) AS start_time,
  arg_max(end_time, seg_no) AS end_time,
  bool_or({MARKED}) OR sum(len(regexp_extract_all(text, '{PROSE.script_char}'))) >= 12 AS informative,
  trim(string_agg({sql_squeeze('text')}, '{PROSE.block_joiner}' ORDER BY seg_no), ' ，,') AS joined FROM b GROUP BY meeting_id, island),
h AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, informative ORDER BY island) AS line_no,
  bool_or(informative) OVER (PARTITION BY meeting_id) AS anyone FROM g)
"""


@query("W02_utterance_blocks", with_(SEGMENTS) + _W02.replace("GAP", "6.0") + f"""
SELECT meeting_id, line_no, speaker, turns, start_time, end_time, '[' || speaker || '] ' ||
  CASE WHEN length(joined) > 180 THEN rtrim(substr(joined, 1, 180), ' ，,') || '...' ELSE joined END AS line
FROM h WHERE informative = anyone AND line_no <= 90
UNION ALL SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) AS line_no, speaker, 1, start_time,
  end_time, '[' || speaker || '] ' || {sql_strip('text')} FROM segments
WHERE {sql_strip('text')} <> '' AND meeting_id NOT IN (SELECT meeting_id FROM kept)
QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) <= 20""")
def utterance_blocks(spark, d):
    return ops.utterance_blocks(t.segments(spark, d), pack=PROSE)


_CHUNKS = "SELECT user_id AS meeting_id, event_id // 100 AS chunk_id, min(epoch_us(ts)) / 1e6 AS start_time FROM events GROUP BY ALL"


@query("W03_stitch_chunks", f"""
WITH c AS ({_CHUNKS}) SELECT user_id AS meeting_id, event_id AS seg_no, round(value + c.start_time, 3) AS start_time,
  round(value * 2 + c.start_time, 3) AS end_time FROM events JOIN c ON user_id = c.meeting_id AND event_id // 100 = c.chunk_id""")
def stitch_chunks(spark, d):
    ev = t.timed_events(spark, d).withColumn("chunk_id", F.floor(F.col("seg_no") / 100))
    chunks = ev.groupBy("meeting_id", "chunk_id").agg(F.min("start_time").alias("start_time"))
    minutes = (F.col("end_time") - F.col("start_time")) / 60
    local = ev.withColumn("_m", minutes).withColumn("start_time", F.col("_m")).withColumn("end_time", F.col("_m") * 2)
    out = ops.stitch_chunks(local, chunks)
    return out.select("meeting_id", "seg_no", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


@query("W04_chunk_plan", with_(MEETINGS) + """
SELECT 'extend' AS variant, id, k AS chunk_no, CAST(k * 180 AS DOUBLE) AS chunk_start, least(duration, k * 180.0 + 182.0) AS chunk_end FROM (
  SELECT id, duration, unnest(range(CASE WHEN duration <= 180 THEN 1 ELSE CAST(ceil(duration / 180) AS BIGINT) END)) AS k FROM meetings WHERE duration > 0)
UNION ALL SELECT 'step', id, k, CAST(k * 180 AS DOUBLE), least(duration, k * 180.0 + 182.0) FROM (
  SELECT id, duration, unnest(range(CAST(ceil(duration / 180) AS BIGINT))) AS k FROM meetings WHERE duration > 0)
UNION ALL SELECT 'inside', id, k, CAST(k * 178 AS DOUBLE), least(duration, k * 178.0 + 180.0) FROM (
  SELECT id, duration, unnest(range(CASE WHEN duration <= 180 THEN 1 ELSE CAST(ceil(duration / 178) AS BIGINT) END)) AS k FROM meetings WHERE duration > 0)""")
def chunk_plan(spark, d):
    m = t.meetings(spark, d)
    parts = [
        ops.chunk_plan(m, 180, 2, v).select(F.lit(v).alias("variant"), "id", "chunk_no", "chunk_start", "chunk_end")
        for v in ("extend", "step", "inside")
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("W05_fixed_segments", with_(MEETINGS) + """
SELECT 'client' AS variant, id, k AS seg_no, 'SPEAKER_00' AS speaker, k * 30.0 AS start_time, round(least(k * 30.0 + 30, duration), 2) AS end_time
FROM (SELECT id, duration, unnest(range(0, CAST(floor(duration) AS BIGINT), 30)) // 30 AS k FROM meetings WHERE duration >= 1)
WHERE least(k * 30.0 + 30, duration) - k * 30.0 >= 1
UNION ALL SELECT 'virtual', id, k, 'SPEAKER_0' || (k % 2), k * s, least(k * s + s, duration) FROM (
  SELECT id, duration, CASE WHEN duration <= 30 THEN duration / 2 ELSE 30.0 END AS s,
    unnest(range(CASE WHEN duration <= 30 THEN 2 ELSE CAST(ceil(duration / 30) AS BIGINT) END)) AS k FROM meetings WHERE duration > 0)""")
def fixed_segments(spark, d):
    m = t.meetings(spark, d)
    cols = ["id", "seg_no", "speaker", "start_time", "end_time"]
    a = ops.fixed_segments(m, 30, "client").select(F.lit("client").alias("variant"), *cols)
    return a.unionAll(ops.fixed_segments(m, 30, "virtual").select(F.lit("virtual").alias("variant"), *cols))


def _series(spark, d):
    return t.timed_events(spark, d).select(
        F.col("meeting_id").alias("recording_id"), F.col("start_time").alias("ts"),
        ((F.col("end_time") - F.col("start_time")) / 60).alias("value"), "seg_no",
    )


@query("W06_quiet_regions", """
WITH s AS (SELECT user_id AS recording_id, epoch_us(ts) / 1e6 AS ts, value FROM events),
h AS (SELECT recording_id, CAST(floor(ts / 43200) AS BIGINT) AS slot, value FROM s),
f AS (SELECT recording_id, slot - o AS frame_no, sqrt(avg(value * value)) AS rms FROM h, (VALUES (0), (1)) v(o) GROUP BY ALL),
e AS (SELECT recording_id, max(ts) AS stop FROM s GROUP BY 1),
q AS (SELECT f.*, stop, frame_no - row_number() OVER (PARTITION BY recording_id ORDER BY frame_no) AS run FROM f JOIN e USING (recording_id)
  WHERE frame_no * 43200.0 + 86400.0 <= stop AND (rms <= 0 OR 20 * log10(rms) < 26.0)),
r AS (SELECT recording_id, min(frame_no) * 43200.0 AS start_time, CASE WHEN max(frame_no) = floor((min(stop) - 86400.0) / 43200.0)
  THEN min(stop) ELSE (max(frame_no) + 1) * 43200.0 END AS end_time FROM q GROUP BY recording_id, run)
SELECT recording_id, CAST(start_time AS DOUBLE) AS start_time, round(end_time, 3) AS end_time FROM r WHERE end_time - start_time >= 86400""")
def quiet_regions(spark, d):
    out = ops.quiet_regions(_series(spark, d), frame=86400.0, threshold_db=26.0, min_len=86400.0)
    return out.select("recording_id", "start_time", F.round("end_time", 3).alias("end_time"))


@query("W07_normalize_level", """
WITH s AS (SELECT user_id, event_id, value / 1000 AS v FROM events),
g AS (SELECT user_id, sqrt(avg(v * v)) AS rms FROM s GROUP BY 1)
SELECT s.user_id AS recording_id, event_id AS seg_no, round(greatest(-1, least(1, v * least(pow(10.0, (-20 - 20 * log10(rms)) / 20), 10))), 6) AS value
FROM s JOIN g USING (user_id)""")
def normalize_level(spark, d):
    out = ops.normalize_level(_series(spark, d).withColumn("value", F.col("value") / 1000))
    return out.select("recording_id", "seg_no", F.round("value", 6).alias("value"))


@query("A06_speaker_contribution", with_(SEGMENTS) + """
SELECT meeting_id, speaker, round(s, 3) AS seconds, round(CASE WHEN sum(s) OVER (PARTITION BY meeting_id) > 0
  THEN s / sum(s) OVER (PARTITION BY meeting_id) * 100 ELSE s END, 3) AS contribution
FROM (SELECT meeting_id, speaker, sum(end_time - start_time) AS s FROM segments GROUP BY ALL)""")
def speaker_contribution(spark, d):
    return ops.speaker_contribution(t.segments(spark, d)).select(
        "meeting_id", "speaker", F.round("seconds", 3).alias("seconds"), F.round("contribution", 3).alias("contribution")
    )


_UNITS = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+'))"
_STATS = f"""SELECT meeting_id, speaker, round(duration, 3) AS duration, word_count, dialogue_units, segment_count,
  round(100 * CASE WHEN sum(dialogue_units) OVER w > 0 THEN dialogue_units / sum(dialogue_units) OVER w
    WHEN sum(duration) OVER w > 0 THEN duration / sum(duration) OVER w
    ELSE segment_count / sum(segment_count) OVER w END, 2) AS percentage FROM (
  SELECT meeting_id, speaker, sum(greatest(0, end_time - start_time)) AS duration,
    CAST(sum(len(regexp_extract_all(text, '[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+'))) AS BIGINT) AS word_count,
    CAST(sum({_UNITS}) AS BIGINT) AS dialogue_units, count(*) AS segment_count FROM segments GROUP BY ALL)
  WINDOW w AS (PARTITION BY meeting_id)"""


@query("A07_speaker_stats", with_(SEGMENTS) + _STATS)
def speaker_stats(spark, d):
    return ops.speaker_stats(t.segments(spark, d)).withColumn("duration", F.round("duration", 3))


@query("W10_speaker_share_band", with_(SEGMENTS) + f"""
SELECT meeting_id, speaker, percentage, CASE WHEN percentage > 60 THEN 'dominant' WHEN percentage > 30 THEN 'active' ELSE 'quiet' END AS band
FROM ({_STATS})""")
def speaker_share_band(spark, d):
    return ops.speaker_share_band(ops.speaker_stats(t.segments(spark, d))).select("meeting_id", "speaker", "percentage", "band")


@query("A08_diarization_stats", with_(EVENTS) + """
SELECT meeting_id, speaker, count(*) AS segment_count, round(sum(end_time - start_time), 2) AS total_duration,
  round(avg(end_time - start_time), 2) AS avg_duration, count(DISTINCT speaker) AS speakers
FROM timed GROUP BY ROLLUP (meeting_id, speaker) HAVING meeting_id IS NOT NULL""")
def diarization_stats(spark, d):
    out = ops.diarization_stats(t.timed_events(spark, d))
    return out.withColumn("total_duration", F.round("total_duration", 2)).withColumn("avg_duration", F.round("avg_duration", 2))


@query("A09_speaker_summary", with_(SEGMENTS) + f"""
SELECT meeting_id, speaker, count(*) AS total_segments, round(sum(end_time - start_time), 3) AS total_duration,
  CAST(sum(length(text)) AS BIGINT) AS total_text_length FROM segments WHERE {sql_strip('text')} <> '' GROUP BY ALL""")
def speaker_summary(spark, d):
    return ops.speaker_summary(t.segments(spark, d)).withColumn("total_duration", F.round("total_duration", 3))


@query("A09_segment_previews", with_(SEGMENTS) + f"""
SELECT meeting_id, speaker, seg_no, start_time, end_time,
  CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
FROM segments WHERE {sql_strip('text')} <> ''""")
def segment_previews(spark, d):
    return ops.segment_previews(t.segments(spark, d))


@query("A10_segments_per_speaker", with_(SEGMENTS) + "SELECT meeting_id, speaker, count(*) AS n FROM segments GROUP BY ALL")
def segments_per_speaker(spark, d):
    return ops.segments_per_speaker(t.segments(spark, d))


@query("A11_transcript_facts", with_(SEGMENTS) + """
SELECT meeting_id, count(DISTINCT speaker) AS speakers_with_text, string_agg(DISTINCT speaker, '|' ORDER BY speaker) AS speakers,
  count(*) AS segments, arg_min(start_time, seg_no) AS first_start, arg_max(end_time, seg_no) AS last_end,
  round(arg_max(end_time, seg_no) - arg_min(start_time, seg_no), 3) AS span FROM segments GROUP BY 1""")
def transcript_facts(spark, d):
    return ops.transcript_facts(t.segments(spark, d)).withColumn("speakers", F.array_join("speakers", "|")).withColumn(
        "span", F.round("span", 3)
    )


@query("A11_transcript_timestamps", with_(SEGMENTS) + """
SELECT meeting_id, start_time AS mark FROM segments
UNION ALL SELECT meeting_id, arg_max(end_time, seg_no) FROM segments GROUP BY 1""")
def transcript_timestamps(spark, d):
    return ops.transcript_timestamps(t.segments(spark, d))


@query("P04_search_segments", with_(SEGMENTS) + """
SELECT meeting_id, seg_no, speaker, (SELECT count(*) FROM segments WHERE contains(lower(text), 'that')) AS total
FROM segments WHERE contains(lower(text), 'that') ORDER BY meeting_id, seg_no LIMIT 20 OFFSET 10""")
def search_segments(spark, d):
    return ops.search_segments(t.segments(spark, d), "That", 10, 20).select("meeting_id", "seg_no", "speaker", "total")


@query("P04_by_speaker", with_(SEGMENTS) + "SELECT meeting_id, seg_no, start_time, end_time FROM segments WHERE speaker = 'assistant'")
def by_speaker(spark, d):
    return ops.by_speaker(t.segments(spark, d), "assistant").select("meeting_id", "seg_no", "start_time", "end_time")


@query("J03_assign_speaker", with_(EVENTS) + """
, tr AS (SELECT * FROM timed WHERE speaker IN ('click', 'view')), di AS (SELECT * FROM timed WHERE speaker NOT IN ('click', 'view')),
p AS (SELECT tr.meeting_id, tr.seg_no, di.speaker AS who, di.seg_no AS turn,
    least(tr.end_time, di.end_time) - greatest(tr.start_time, di.start_time) AS o
  FROM tr JOIN di ON tr.meeting_id = di.meeting_id AND tr.start_time < di.end_time AND di.start_time < tr.end_time),
best AS (SELECT meeting_id, seg_no, who, o FROM p WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY meeting_id, seg_no ORDER BY o DESC, turn) = 1)
SELECT tr.meeting_id, tr.seg_no, coalesce(who, speaker) AS speaker, round(o, 3) AS overlap FROM tr LEFT JOIN best USING (meeting_id, seg_no)
UNION ALL SELECT meeting_id, seg_no, speaker, NULL FROM di WHERE meeting_id NOT IN (SELECT meeting_id FROM tr)""")
def assign_speaker(spark, d):
    ev, said = t.timed_events(spark, d), F.col("speaker").isin("click", "view")
    out = ops.assign_speaker(ev.filter(said), ev.filter(~said), bucket=1800.0)
    return out.select("meeting_id", "seg_no", "speaker", F.round("overlap", 3).alias("overlap"))


@query("J07_align_segments", with_(EVENTS) + """
, rec AS (SELECT event_id AS turn_id, CASE WHEN event_type IN ('click', 'view') THEN value END AS rs, CASE WHEN event_type IN ('click', 'view') THEN value * 70 END AS re, ' ' || event_type || ' ' AS txt,
    (event_id % 7) / 7 AS rc FROM events WHERE event_type <> 'error')
SELECT meeting_id, seg_no AS turn_id, speaker, round(CASE WHEN rs IS NOT NULL THEN start_time + rs ELSE start_time END, 2) AS start_time,
  round(CASE WHEN rs IS NOT NULL THEN least(start_time + re, end_time) ELSE end_time END, 2) AS end_time,
  CASE WHEN txt IS NOT NULL THEN trim(txt) ELSE text END AS text,
  round(CASE WHEN rs IS NOT NULL THEN rc WHEN txt IS NOT NULL THEN confidence * 0.9 ELSE 0.1 END, 5) AS confidence
FROM timed LEFT JOIN rec ON turn_id = seg_no""")
def align_segments(spark, d):
    turns = t.timed_events(spark, d).withColumnRenamed("seg_no", "turn_id")
    piece, value = F.col("event_type").isin("click", "view"), F.col("value")
    rec = t.load(spark, d, "events").filter(F.col("event_type") != "error").select(
        F.col("event_id").alias("turn_id"), F.when(piece, value).alias("start"), F.when(piece, value * 70).alias("end"),
        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("text"), ((F.col("event_id") % 7) / 7).alias("confidence"),
    )
    out = ops.align_segments(turns, rec)
    return out.select(
        "meeting_id", "turn_id", "speaker", F.round("start_time", 2).alias("start_time"), F.round("end_time", 2).alias("end_time"),
        "text", F.round("confidence", 5).alias("confidence"),
    )


@query("S05_to_srt", with_(SEGMENTS) + """
SELECT meeting_id, n AS cue_no, n || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' ||
  printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text AS cue
FROM (SELECT meeting_id, text, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) AS n,
  CAST(round(start_time * 1000) AS BIGINT) AS a, CAST(round(end_time * 1000) AS BIGINT) AS b FROM segments)""")
def to_srt(spark, d):
    return ops.to_srt(t.segments(spark, d))


@query("S05_to_vtt", with_(SEGMENTS) + """
SELECT DISTINCT meeting_id, 0 AS cue_no, 'WEBVTT' AS cue FROM segments UNION ALL
SELECT meeting_id, n, printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' ||
  printf('%02d:%02d:%02d.%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text
FROM (SELECT meeting_id, text, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) AS n,
  CAST(round(start_time * 1000) AS BIGINT) AS a, CAST(round(end_time * 1000) AS BIGINT) AS b FROM segments)""")
def to_vtt(spark, d):
    return ops.to_vtt(t.segments(spark, d))


@query("W08_first_last_segment", with_(SEGMENTS) + """
SELECT meeting_id, arg_min(speaker, seg_no) AS first_speaker, arg_max(speaker, seg_no) AS last_speaker,
  arg_max(end_time, seg_no) AS clock FROM segments GROUP BY 1""")
def first_last_segment(spark, d):
    return t.segments(spark, d).groupBy("meeting_id").agg(
        F.min_by("speaker", "seg_no").alias("first_speaker"), F.max_by("speaker", "seg_no").alias("last_speaker"),
        F.max_by("end_time", "seg_no").alias("clock"),
    )
