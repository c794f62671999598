"""Queries that build documents, parse stored replies and run the composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.speech import sql_strip
from colloquy.catalog.views import COMMENTS, MEETINGS, SEGMENTS, TASKS, stamp, with_
from colloquy.catalog.mining import CAND, DEDUPED, _ACT, _DEC, _ISS, _PARTS_X11, _RANK, _TOPICS, _clean
from colloquy.catalog.writing import CANDIDATES, PIECES, _cut, docs, sql_clean
from colloquy.operators import summary as su
from colloquy.packs import PROSE
from colloquy.plans import insights
from colloquy.sources import exports as out, tables as t

P = PROSE
NOW = "2024-03-20 09:30:00"
FMT = "yyyy-MM-dd HH:mm:ss"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def notes(spark, d):
    """Comments with the meeting of their task."""
    owner = t.tasks(spark, d).select(F.col("id").alias("task_id"), "meeting_id")
    return t.comments(spark, d).join(owner, "task_id")


NOTES = "notes AS (SELECT comments.*, tasks.meeting_id FROM comments JOIN tasks ON tasks.id = task_id)"


@query("S04_transcript_lines", with_(SEGMENTS) + """
SELECT meeting_id, seg_no, printf('[%.2f - %.2f] %s: %s', start_time, end_time, speaker, text) AS line FROM segments""")
def transcript_lines(spark, d):
    return t.segments(spark, d).select("meeting_id", "seg_no", out.transcript_line().alias("line"))


@query("S06_export_tasks_csv", with_(TASKS) + f"""
SELECT id, id || ',"' || replace(title, '"', '""') || '",' || meeting_id || ',' || status || ',' || coalesce(priority, '') || ',' ||
  coalesce({ISO.format('due_date')}, '') || ',' || assignee_id || ',"",' || confidence || ',' || {ISO.format('created_at')} || ',' AS line
FROM tasks WHERE status = 'pending'""")
def export_tasks_csv(spark, d):
    return out.export_tasks(t.tasks(spark, d), "csv", status="pending")


@query("S06_export_tasks_json", with_(TASKS) + f"""
SELECT id, CAST(to_json({{'id': id, 'title': title, 'meeting_id': meeting_id, 'status': status, 'priority': priority, 'due_date': {ISO.format('due_date')},
  'assignee_id': assignee_id, 'assignee_name': NULL, 'confidence': confidence, 'created_at': {ISO.format('created_at')}, 'updated_at': NULL}}) AS VARCHAR) AS line FROM tasks""")
def export_tasks_json(spark, d):
    return out.export_tasks(t.tasks(spark, d), "json")


_PART = "(row_number() OVER (PARTITION BY meeting_id ORDER BY {}) - 1) // 5 AS part"
_PARTS = f"""
, {NOTES}, s AS (SELECT meeting_id, part, count(*) AS n, string_agg(speaker, ',' ORDER BY seg_no) AS v FROM (SELECT *, {_PART.format('seg_no')} FROM segments) GROUP BY ALL),
k AS (SELECT meeting_id, part, count(*) AS n, string_agg(id, ',' ORDER BY id) AS v, string_agg('- [' || status || '] ' || title, chr(10) ORDER BY id) AS md FROM (SELECT *, {_PART.format('id')} FROM tasks) GROUP BY ALL),
c AS (SELECT meeting_id, part, count(*) AS n, string_agg(content, ',' ORDER BY id, content) AS v, string_agg('- ' || content, chr(10) ORDER BY id, content) AS md FROM (SELECT *, {_PART.format('id, content')} FROM notes) GROUP BY ALL),
p AS (SELECT id AS meeting_id, 0 AS part FROM meetings UNION SELECT meeting_id, part FROM s UNION SELECT meeting_id, part FROM k UNION SELECT meeting_id, part FROM c)
"""


def _exported(spark, d):
    return out.export_meetings(t.meetings(spark, d), t.segments(spark, d), t.tasks(spark, d), notes(spark, d), part_rows=5)


@query("S07_export_meetings", with_(MEETINGS, SEGMENTS, TASKS, COMMENTS) + _PARTS + """
SELECT p.meeting_id AS id, p.part, m.title, coalesce(s.n, 0) AS segments, coalesce(k.n, 0) AS tasks, coalesce(c.n, 0) AS comments,
  coalesce(s.v, '') AS speakers, coalesce(k.v, '') AS task_ids, coalesce(c.v, '') AS contents
FROM p JOIN meetings m ON m.id = p.meeting_id LEFT JOIN s ON s.meeting_id = p.meeting_id AND s.part = p.part
LEFT JOIN k ON k.meeting_id = p.meeting_id AND k.part = p.part LEFT JOIN c ON c.meeting_id = p.meeting_id AND c.part = p.part""")
def export_meetings(spark, d):
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("bigint").alias(c)
    joined = lambda c, name: F.coalesce(F.array_join(c, ","), F.lit("")).alias(name)
    return _exported(spark, d).select(
        "id", "part", F.col("meeting.title").alias("title"), size("segments"), size("tasks"), size("comments"),
        joined("segments.speaker", "speakers"), joined(F.transform("tasks.id", lambda v: v.cast("string")), "task_ids"), joined("comments.content", "contents"),
    )


@query("S08_meeting_markdown", with_(MEETINGS, SEGMENTS, TASKS, COMMENTS) + _PARTS + """
SELECT p.meeting_id AS id, p.part, '# 会议导出 - ' || m.title || chr(10) || chr(10) || '## 会议信息' || chr(10) || '- ID: ' || m.id || chr(10) || '- 状态: ' || m.status || chr(10)
  || '- 时长: ' || m.duration || chr(10) || chr(10) || '## 会议摘要' || chr(10) || m.description || chr(10) || chr(10) || '## 决策项' || chr(10) || '- ' || m.status || chr(10) || chr(10)
  || '## 未解决问题' || chr(10) || chr(10) || '## 行动项' || coalesce(chr(10) || k.md, '') || chr(10) || chr(10) || '## 协作记录' || coalesce(chr(10) || c.md, '') AS markdown
FROM p JOIN meetings m ON m.id = p.meeting_id
LEFT JOIN k ON k.meeting_id = p.meeting_id AND k.part = p.part LEFT JOIN c ON c.meeting_id = p.meeting_id AND c.part = p.part""")
def meeting_markdown(spark, d):
    rows = _exported(spark, d).withColumn("summary", F.col("meeting.description")).withColumn("decisions", F.array("meeting.status"))
    return out.meeting_markdown(rows)


@query("S09_meeting_report", with_(MEETINGS, TASKS) + f"""
, k AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY id) AS r, * EXCLUDE (meeting_id) FROM tasks),
a AS (SELECT meeting_id, (r - 1) // 8 AS part, string_agg(r || '. **' || title || '**' || chr(10) || '   - 负责人: u' || assignee_id || coalesce(chr(10) || '   - 截止日期: ' || {stamp('due_date')}, ''), chr(10) ORDER BY r) AS items FROM k GROUP BY 1, 2)
SELECT meeting_id AS id, part, items AS report FROM a WHERE part > 0 UNION ALL
SELECT id, 0, '# 会议报告: ' || title || chr(10) || chr(10) || '**会议ID**: ' || id || chr(10) || chr(10) || '## 会议信息' || chr(10) || chr(10) || '- **日期**: 未知' || chr(10) || '- **时长**: ' || owner_id
  || '分钟' || chr(10) || '- **参与者**: ' || CASE WHEN id % 2 = 0 THEN 'Ann, ' || description ELSE '未知' END || chr(10) || chr(10) || '## 会议摘要' || chr(10) || chr(10) || description
  || coalesce(chr(10) || chr(10) || '## 行动项' || chr(10) || chr(10) || items, '') || chr(10) || chr(10) || '## 关键主题' || chr(10) || chr(10) || '- **' || description || '**' || chr(10) || '  - 关键词: ' || status || ', ' || description
  || chr(10) || chr(10) || '## 会议决策' || chr(10) || chr(10) || '- ' || status AS report FROM meetings LEFT JOIN a ON a.meeting_id = id AND a.part = 0""")
def meeting_report(spark, d):
    items = t.tasks(spark, d).select(
        F.col("meeting_id").alias("id"), F.col("id").alias("task_id"), F.col("title").alias("description"),
        F.concat(F.lit("u"), F.col("assignee_id").cast("string")).alias("assignee"), F.date_format("due_date", FMT).alias("due_date"),
    )
    names = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Ann, "), "description"))
    rows = t.meetings(spark, d).withColumn("_p", names).withColumn("participants", out.participants("_p"))
    rows = rows.withColumn("date", F.lit(None).cast("string")).withColumn("minutes", F.col("owner_id")).withColumn("summary", F.col("description"))
    rows = rows.withColumn("key_topics", F.array(F.struct(F.col("description").alias("name"), F.array("status", "description").alias("keywords"))))
    return out.report_parts(rows.withColumn("decisions", F.array("status")), items, 8)


@query("S10_pick_summary", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'insight ' || lang WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 4 = 2 THEN substr({sql_strip('text')}, 1, 300)
  ELSE substr({sql_strip("lang || ' ' || text")}, 1, 300) END AS summary,
  CASE WHEN length({sql_strip('text')}) <= 1500 THEN {sql_strip('text')} ELSE substr({sql_strip('text')}, 1, 1500) || '...' END AS excerpt,
  CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE '未知' END AS people FROM documents""")
def pick_summary(spark, d):
    k = F.col("doc_id") % 4
    chosen = out.pick_summary(
        F.when(k == 0, F.concat(F.lit("insight "), "lang")).otherwise("  "), F.when(k == 1, F.col("source")),
        F.when(k == 2, F.col("text")), F.concat_ws(" ", "lang", "text"),
    )
    rows = docs(spark, d).withColumn("p", F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(" ,, "), "source")).otherwise(" , "))
    return rows.select("doc_id", chosen.alias("summary"), out.excerpt("text").alias("excerpt"), F.array_join(out.participants("p"), "|").alias("people"))


def eid():
    return F.col("event_id")


@query("S11_parse_topics", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '[]|u' || user_id || '[]' WHEN 1 THEN event_type || '[u' || user_id || ',k]' ELSE '' END AS topics FROM events""")
def parse_topics(spark, d):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    raw = (
        F.when(eid() % 4 == 0, F.concat(F.lit('["'), kind, F.lit(' ", "", "u'), user, F.lit('"]')))
        .when(eid() % 4 == 1, F.concat(F.lit('[{"name": "'), kind, F.lit('", "keywords": ["u'), user, F.lit('", "k"]}, {"keywords": ["z"]}]')))
        .when(eid() % 4 == 2, F.lit("not json")).otherwise(F.col("props"))
    )
    shown = F.transform(out.parse_topics(raw), lambda v: F.concat(v["name"], F.lit("["), F.array_join(v["keywords"], ","), F.lit("]")))
    return t.load(spark, d, "events").select("event_id", F.array_join(shown, "|").alias("topics"))


def _reply(body, fixed):
    """A stored model reply around a JSON body, in the forms replies come in."""
    k = eid() % 6
    return (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nbye")))
        .when(k == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked"))).when(k == 3, fixed)
        .when(k == 4, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.lit("sorry, no answer"))
    )


@query("S12_extract_json", """
SELECT event_id, CASE WHEN event_id % 6 < 4 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 6 = 4 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS in_list, event_id % 6 < 5 AS found FROM events""")
def extract_json(spark, d):
    broken = F.concat(F.regexp_replace(F.regexp_replace("props", '"', "'"), "\\}$", ", }"))
    v = F.try_parse_json(F.col("j"))
    rows = t.load(spark, d, "events").select("event_id", out.extract_json(_reply(F.col("props"), broken)).alias("j"))
    return rows.select(
        "event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$[0].k", "bigint").alias("in_list"), F.col("j").isNotNull().alias("found")
    )


@query("S13_validate_summary", """
SELECT event_id, CASE WHEN ok THEN 'about ' || event_type ELSE '' END AS summary, CASE WHEN ok THEN event_type || '/topic_1/0.8' ELSE '' END AS topics,
  CASE WHEN ok THEN 'go' ELSE '' END AS decisions, CASE WHEN ok THEN greatest(-1, least(1, value / 20 - 1)) ELSE 0 END AS mood,
  'abstractive' AS summary_type FROM (SELECT *, event_id % 6 < 4 AS ok FROM events)""")
def validate_summary(spark, d):
    kind, value = F.col("event_type"), (F.col("value") / 20 - 1).cast("string")

    def body(q: str):
        s = lambda v: F.lit(v.replace('"', q))
        return F.concat(
            s('{"summary": " about '), kind, s(' ", "key_topics": [{"name": "'), kind, s('", "keywords": ["a", " "]}, {"name": ""}], "decisions": ["go", " "], "sentiment_overall": '),
            value, s("}"),
        )

    rows = t.load(spark, d, "events").select("event_id", _reply(body('"'), body("'")).alias("response"))
    topics = F.transform("key_topics", lambda v: F.concat_ws("/", v["name"], v["id"], v["confidence"].cast("string")))
    return out.validate_summary(rows).select(
        "event_id", "summary", F.array_join(topics, "|").alias("topics"), F.array_join("decisions", "|").alias("decisions"),
        F.col("sentiment_overall").alias("mood"), "summary_type",
    )


@query("S14_validate_tasks", """
SELECT event_id, 'move the ' || event_type || ' on' AS description, CASE WHEN event_type <> 'purchase' AND event_type <> 'click' THEN 'Mr' || left(event_type, 4) END AS assignee,
  CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '2024-03-22 09:30:00' END AS due_date,
  CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS priority, least(1, value / 20) AS confidence FROM events WHERE event_id % 6 < 4""")
def validate_tasks(spark, d):
    kind = F.col("event_type")
    due = F.when(eid() % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(eid() % 3 == 1, "this").otherwise("whenever")
    who = F.when(kind.isin("purchase", "click"), F.lit("wh")).otherwise(F.concat(F.lit("Mr"), F.substring(kind, 1, 4)))

    def body(q: str):
        s = lambda v: F.lit(v.replace('"', q))
        return F.concat(
            s('{"action_items": [{"description": "move the '), kind, s(' on", "assignee": "'), who, s('", "due_date": "'), due, s('", "priority": "'),
            F.when(kind == "error", "HIGH").otherwise("someday"), s('", "confidence": '), (F.col("value") / 20).cast("string"), s('}, {"description": "short"}, "odd"]}'),
        )

    rows = t.load(spark, d, "events").select("event_id", _reply(body('"'), body("'")).alias("response"))
    return out.validate_tasks(rows, ["event_id"], NOW, pack=P).select(
        "event_id", "description", "assignee", F.date_format("due_date", FMT).alias("due_date"), "priority", "confidence"
    )


@query("S15_segments_ms", with_(SEGMENTS) + """
SELECT meeting_id, part, count(*) AS segments, string_agg(text, ' ' ORDER BY seg_no) AS original_text, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers,
  round(min(start_time) * 1000, 3) AS first_ms, round(max(end_time) * 1000, 3) AS last_ms
FROM (SELECT *, (row_number() OVER (PARTITION BY meeting_id ORDER BY seg_no) - 1) // 4 AS part FROM segments) GROUP BY ALL""")
def segments_ms(spark, d):
    return out.segments_ms(t.segments(spark, d), part_rows=4).select(
        "meeting_id", "part", F.size("segments").cast("bigint").alias("segments"), "original_text", F.array_join("speakers", ",").alias("speakers"),
        F.round(F.array_min("segments.start_ms"), 3).alias("first_ms"), F.round(F.array_max("segments.end_ms"), 3).alias("last_ms"),
    )


@query("J08_meeting_detail", with_(MEETINGS, SEGMENTS, TASKS, COMMENTS) + f""", {NOTES}
SELECT id, title, (SELECT count(*) FROM segments s WHERE s.meeting_id = m.id) AS segments, (SELECT max(end_time) FROM segments s WHERE s.meeting_id = m.id) AS length,
  (SELECT count(*) FROM tasks s WHERE s.meeting_id = m.id) AS tasks, {stamp('(SELECT min(due_date) FROM tasks s WHERE s.meeting_id = m.id)')} AS first_due,
  (SELECT count(*) FROM notes s WHERE s.meeting_id = m.id) AS comments FROM meetings m""")
def meeting_detail(spark, d):
    rows = out.meeting_detail(t.meetings(spark, d), t.segments(spark, d), t.tasks(spark, d), notes(spark, d))
    return rows.withColumn("first_due", F.date_format("first_due", FMT))


def lowered(c: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({c}, '{P.token}'), lambda w: lower(w)))"


@query("P11_summary_ok", f"""
SELECT doc_id, length(s) >= 20 AND NOT regexp_matches(s, '(?i){"|".join(P.refusals)}') AND (doc_id % 5 = 1 OR NOT (len(list_intersect(mine, theirs)) = 0
    AND len(list_filter(mine, lambda w: contains(lower(text), w))) = 0 AND len(mine) >= 8 AND len(theirs) >= 20)) AS accepted
FROM (SELECT doc_id, text, s, {lowered('s')} AS mine, {lowered('text')} AS theirs FROM (SELECT doc_id, text, {sql_strip('''CASE doc_id % 5 WHEN 0 THEN 'Alas I cannot ACCESS this recording' WHEN 1 THEN
  'zqxa zqxb zqxc zqxd zqxe zqxf zqxg zqxh zqxi' WHEN 2 THEN 'zqxa zqxb zqxc zqxd zqxe zqxf zqxg zqxh zqxi' WHEN 3 THEN 'tiny' ELSE text END''')} AS s FROM documents))""")
def summary_ok(spark, d):
    k, far = F.col("doc_id") % 5, "zqxa zqxb zqxc zqxd zqxe zqxf zqxg zqxh zqxi"
    none = F.array().cast("array<string>")
    summary = (
        F.when(k == 0, "Alas I cannot ACCESS this recording").when(k.isin(1, 2), far).when(k == 3, "tiny").otherwise(F.col("text"))
    )
    rows = docs(spark, d).withColumn("summary", summary).withColumn("source", F.col("text")).withColumn("key_topics", none)
    rows = rows.withColumn("decisions", F.when(k == 1, F.array(F.lit("go"))).otherwise(none)).withColumn("open_issues", none)
    return rows.select("doc_id", su.summary_ok(rows, P).alias("accepted"))


# --- composed jobs -----------------------------------------------------------------------------------------

def _hits(words) -> str:
    return " + ".join(f"CAST(contains(t, '{w}') AS BIGINT)" for w in words)


@query("X17_process_transcript", f"""
WITH s AS (SELECT conv_id AS meeting_id, turn AS seg_no, role AS speaker, {sql_strip('text')} AS t FROM conversations),
w AS (SELECT meeting_id, seg_no, unnest(regexp_extract_all(t, '{P.token}')) AS w, unnest(range(len(regexp_extract_all(t, '{P.token}')))) AS i FROM s),
f AS (SELECT meeting_id, seg_no, w, count(*) AS n, min(i) AS fst FROM w GROUP BY ALL),
k AS (SELECT meeting_id, seg_no, string_agg(w, '|' ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, seg_no ORDER BY n DESC, fst) AS r FROM f QUALIFY r <= 3) GROUP BY ALL),
o AS (SELECT meeting_id, seg_no, len(list_distinct(list_filter(list_concat({', '.join(f"regexp_extract_all(t, '{p}', 1)" for p in P.org_regexes)}), lambda v: length(v) >= 2))) AS organizations FROM s),
m AS (SELECT meeting_id, seg_no, p, n FROM (SELECT meeting_id, seg_no, {_hits(P.positive)} AS p, {_hits(P.negative)} AS n FROM s))
SELECT s.meeting_id, s.seg_no, speaker, coalesce(keywords, '') AS keywords, organizations, CASE WHEN p + n = 0 THEN 'neutral' WHEN (p - n) / (p + n) > 0.1 THEN 'positive'
  WHEN (p - n) / (p + n) < -0.1 THEN 'negative' ELSE 'neutral' END AS mood FROM s LEFT JOIN k USING (meeting_id, seg_no) JOIN o USING (meeting_id, seg_no) JOIN m USING (meeting_id, seg_no)""")
def process_transcript(spark, d):
    rows = insights.process_transcript(t.segments(spark, d), NOW, P, ranked=False)
    orgs = F.filter(F.coalesce("entities", F.array().cast(rows.schema["entities"].dataType.simpleString())), lambda e: e["type"] == "ORG")
    return rows.select(
        "meeting_id", "seg_no", "speaker", F.coalesce(F.array_join("keywords.token", "|"), F.lit("")).alias("keywords"),
        F.size(orgs).cast("bigint").alias("organizations"), F.col("sentiment.label").alias("mood"),
    )


# a turn is a row here, so the rank's key is the meeting and turn in one number
@query("X17_ranked_keywords", f"""WITH said AS (SELECT conv_id, turn, conv_id * 100000 + turn AS doc_id, {sql_strip('text')} AS text FROM conversations),
documents AS (SELECT * FROM said WHERE text <> ''), {_RANK},
r AS (SELECT doc_id, t AS token, s AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, t) AS rank FROM z QUALIFY rank <= 3),
f AS (SELECT doc_id, w AS token, count(*) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS rank FROM (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(text, '{P.token}') AS l FROM documents)) GROUP BY doc_id, w QUALIFY rank <= 3),
b AS (SELECT * FROM r UNION ALL SELECT doc_id, token, CAST(weight AS DOUBLE), rank FROM f WHERE doc_id NOT IN (SELECT doc_id FROM r))
SELECT conv_id AS meeting_id, turn AS seg_no, rank, token, round(weight, 4) AS weight FROM b JOIN said USING (doc_id)""")
def ranked_keywords(spark, d):
    rows = insights.process_transcript(t.segments(spark, d), NOW, P, with_entities=False, with_sentiment=False)
    words = rows.select("meeting_id", "seg_no", F.explode("keywords").alias("w"))
    return words.select("meeting_id", "seg_no", "w.rank", "w.token", F.round("w.weight", 4).alias("weight"))


@query("X17_meeting_enrichment", f"""
WITH w AS (SELECT conv_id, turn * 1000000 + unnest(range(len(l))) AS place, unnest(l) AS w FROM (SELECT conv_id, turn, regexp_extract_all(text, '{P.token}') AS l FROM conversations)),
f AS (SELECT conv_id, w, count(*) AS n, min(place) AS fst FROM w GROUP BY ALL),
k AS (SELECT conv_id, string_agg(w, '|' ORDER BY r) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, fst) AS r FROM f QUALIFY r <= 5) GROUP BY 1)
SELECT c.conv_id AS meeting_id, coalesce(any_value(topics), '') AS topics, count(DISTINCT role) AS speakers, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters
FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id GROUP BY 1""")
def meeting_enrichment(spark, d):
    rows = t.segments(spark, d)
    topics = insights.meeting_topics(rows, 5, P).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("topics"))
    sizes = rows.groupBy("meeting_id").agg(
        F.countDistinct("speaker").alias("speakers"), F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).cast("bigint").alias("characters")
    )
    return sizes.join(topics, "meeting_id", "left").select(
        "meeting_id", F.coalesce(F.array_join("topics.token", "|"), F.lit("")).alias("topics"), "speakers", "segments", "characters"
    )


# a turn is a row and the meeting the key, so places count turns first; three turns are a part
_PART3 = 3
_AT = "turn * 1000000 + unnest(range(len(l)))"
_TURNS = "SELECT conv_id, turn, {} AS l FROM {}"
_LINES = f"""cl AS ({sql_clean(f"(SELECT conv_id, turn, role, {sql_strip('text')} AS text FROM conversations)", "conv_id, turn, role")}),
fl AS (SELECT conv_id, turn, text AS cleaned, CASE WHEN text <> '' THEN role || ': ' || text END AS text FROM cl),
documents AS (SELECT conv_id AS doc_id, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS text FROM fl GROUP BY 1)"""
_CAND = f"cand AS (SELECT conv_id AS doc_id, {_AT} AS pos, unnest(l) AS s FROM ({_TURNS.format(CANDIDATES, 'cl')}))"
_SPOKEN = f"""sents AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rk FROM (SELECT conv_id AS doc_id, {_AT} AS i, unnest(l) AS s FROM (
  {_TURNS.format(f"flatten(list_transform({PIECES}, lambda s: {_cut('s')}))", f"(SELECT conv_id, turn, {_clean('coalesce(text, chr(32))')} AS text FROM fl)")})))"""
_X18 = f"""{DEDUPED.replace(CAND, f"{_LINES}, {_CAND}")},
{_SPOKEN}, {_DEC}, {_ISS}, {_ACT}, {_TOPICS}, {_PARTS_X11},
n AS (SELECT conv_id AS doc_id, CAST(sum(length(cleaned)) + count(*) - 1 AS BIGINT) AS word_count, count(*) AS segments, min(turn) // {_PART3} AS part FROM fl GROUP BY 1),
d AS (SELECT conv_id AS doc_id, round(sum(length(text)) / 10, 3) AS meeting_duration FROM conversations GROUP BY 1),
whole AS (SELECT n.doc_id, part, segments, meeting_duration, word_count, summary, CASE WHEN brief = '' THEN summary ELSE brief END AS executive_summary,
  coalesce((SELECT string_agg(name, '|' ORDER BY rank) FROM topics q WHERE q.doc_id = n.doc_id), '') AS topics,
  coalesce((SELECT string_agg(decision, '|' ORDER BY rank) FROM decs q WHERE q.doc_id = n.doc_id), '') AS decisions,
  coalesce((SELECT string_agg(issue, '|' ORDER BY rank) FROM issues q WHERE q.doc_id = n.doc_id), '') AS open_issues,
  coalesce((SELECT string_agg(action, '|' ORDER BY rank) FROM acts q WHERE q.doc_id = n.doc_id), '') AS actions,
  (SELECT count(*) FROM tasks q WHERE q.doc_id = n.doc_id) AS tasks_found,
  (SELECT string_agg(role || '=' || share, '|' ORDER BY role) FROM (SELECT role, round(sum(length(text)) / sum(sum(length(text))) OVER () * 100, 2) AS share
    FROM conversations q WHERE q.conv_id = n.doc_id GROUP BY role)) AS speaker_contributions
  FROM n JOIN d USING (doc_id) JOIN y USING (doc_id)),
texts AS (SELECT conv_id AS doc_id, turn // {_PART3} AS part, coalesce(string_agg(nullif(cleaned, ''), chr(10) ORDER BY turn), '') AS cleaned_text,
  coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS formatted_text FROM fl GROUP BY ALL),
items AS (SELECT doc_id, pos // 1000000 // {_PART3} AS part, string_agg(description, '|' ORDER BY pos, pattern) AS action_items FROM tasks GROUP BY ALL)
SELECT texts.doc_id AS meeting_id, texts.part, segments, meeting_duration, word_count, summary, executive_summary, topics, decisions, open_issues, actions, tasks_found,
  speaker_contributions, coalesce(action_items, '') AS action_items, cleaned_text, formatted_text
FROM texts LEFT JOIN whole ON whole.doc_id = texts.doc_id AND whole.part = texts.part LEFT JOIN items ON items.doc_id = texts.doc_id AND items.part = texts.part"""


@query("X18_meeting_insights", _X18)
def meeting_insights(spark, d):
    rows = insights.meeting_insights(t.segments(spark, d), NOW, P, part_rows=_PART3)
    shares = F.transform(F.map_entries("speaker_contributions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    listed = lambda c, name: F.array_join(c, "|").alias(name)
    return rows.select(
        "meeting_id", "part", "segments", F.round("meeting_duration", 3).alias("meeting_duration"), "word_count", "summary", "executive_summary",
        listed("topics.name", "topics"), listed("decisions", "decisions"), listed("open_issues", "open_issues"), listed("actions", "actions"),
        "tasks_found", listed("action_items.description", "action_items"), listed(F.array_sort(shares), "speaker_contributions"), "cleaned_text", "formatted_text",
    )
