"""Queries that extract tasks, entities, topics and summaries from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.speech import REPEATED, sql_list, sql_squeeze, sql_strip
from colloquy.catalog.views import SEGMENTS, with_
from colloquy.catalog.writing import CANDIDATES, PIECES, VALID_TOPIC, _cut, docs, placed_docs, sql_rules, sql_tag, sql_task
from colloquy.functions import text as x
from colloquy.operators import extract as ex, speakers as sp, summary as su, topics as tp
from colloquy.packs import PROSE
from colloquy.plans.hot import durable
from colloquy.sources import tables as t

P = PROSE
KEY = ["doc_id"]
NOW = "2024-03-20 09:30:00"
FMT = "yyyy-MM-dd HH:mm:ss"


def stamp(name):
    return F.date_format(name, FMT).alias(name)


def sql_any(c: str, words) -> str:
    return f"regexp_matches({c}, '{x.any_of(words)}')"


# --- tasks ----------------------------------------------------------------------------------------

_DUE = """CASE due_text WHEN 'this' THEN '2024-03-22 09:30:00' WHEN 'that' THEN '2024-04-01 09:30:00' WHEN 'was' THEN '2024-03-31 00:00:00' END"""


def _pattern_sql(i: int, p) -> str:
    part = lambda g: sql_strip(f"regexp_extract(s, '{p.regex}', {g})")
    desc = part(p.task)
    if p.owner:
        desc = f"{part(p.owner)} || '{P.owner_link}' || {desc}"
    if p.due:
        desc = f"{desc} || '{P.due_open}' || {part(p.due)} || '{P.due_close}'"
    who = f"regexp_extract(s, '{p.regex}', {p.owner})" if p.names_assignee else "NULL"
    due = f"regexp_extract(s, '{p.regex}', {p.due})" if p.due else "NULL"
    return (
        f"SELECT doc_id, pos, s, CAST({i} AS BIGINT) AS pattern, {sql_task('d')} AS description, who, due_text FROM (SELECT doc_id, pos, s, {desc} AS d, "
        f"{who} AS who, {due} AS due_text FROM cand WHERE regexp_matches(s, '{p.regex}'))"
    )


CAND = f"cand AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS s FROM (SELECT doc_id, {CANDIDATES} AS l FROM documents))"
FOUND = f"""WITH {CAND},
fit AS ({' UNION ALL '.join(_pattern_sql(i, p) for i, p in enumerate(P.task_patterns))}),
found AS (SELECT doc_id, pos, pattern, description, due_text, length(s) AS match_length, {sql_any('s', P.score_verbs)} AS has_verb,
  CASE WHEN regexp_matches(who, '{P.assignee_regex}') AND who NOT IN {sql_list(P.assignee_block)} AND NOT {sql_any('who', P.assignee_noise)}
    THEN who END AS assignee, {_DUE} AS due_date
  FROM fit WHERE length(description) BETWEEN 6 AND 80 AND NOT regexp_matches(description, 'SPEAKER_|\\[|\\]')
    AND NOT {sql_any('description', P.task_noise)} AND regexp_matches(description, '{P.task_verbs}'))"""
SCORED = FOUND + f""", scored AS (SELECT *, least(95, 70 + CASE WHEN assignee IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN due_text IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN match_length > 20 THEN 5 WHEN match_length < 10 THEN -10 ELSE 0 END + CASE WHEN has_verb THEN 5 ELSE 0 END) / 100 AS confidence,
  CASE WHEN {sql_any('lower(description)', P.high)} THEN 'high' WHEN {sql_any('lower(description)', P.medium)} THEN 'medium' ELSE 'low' END AS priority
  FROM found)"""
DEDUPED = SCORED + f""", keyed AS (SELECT *, regexp_replace(lower({sql_strip('description')}), '[，。！？、；:]|{x.WS}', '', 'g') AS k FROM scored WHERE confidence >= 0.6),
tasks AS (SELECT * EXCLUDE (pos, pattern), first_value(pos) OVER (PARTITION BY doc_id, k ORDER BY pos, pattern) AS pos,
  first_value(pattern) OVER (PARTITION BY doc_id, k ORDER BY pos, pattern) AS pattern,
  row_number() OVER (PARTITION BY doc_id, k ORDER BY confidence DESC, keyed.pos, keyed.pattern) AS best FROM keyed QUALIFY best = 1)"""


@query("X03_extract_tasks", FOUND + "SELECT doc_id, pos, pattern, description, assignee, due_text, due_date FROM found")
def extract_tasks(spark, d):
    return ex.extract_tasks(placed_docs(spark, d), KEY, NOW, P).select(
        "doc_id", F.col("pos._pos").cast("bigint").alias("pos"), F.col("pattern").cast("bigint").alias("pattern"), "description",
        "assignee", "due_text", stamp("due_date"),
    )


@query("X04_score_tasks", SCORED + "SELECT doc_id, pos, pattern, description, priority, round(confidence, 2) AS confidence FROM scored WHERE confidence >= 0.75")
def score_tasks(spark, d):
    found = ex.score_tasks(ex.extract_tasks(placed_docs(spark, d), KEY, NOW, P), P, 0.75)
    return found.select(
        "doc_id", F.col("pos._pos").cast("bigint").alias("pos"), F.col("pattern").cast("bigint").alias("pattern"), "description",
        "priority", F.round("confidence", 2).alias("confidence"),
    )


@query("X05_dedupe_tasks", DEDUPED + "SELECT doc_id, pos, description, assignee, priority, due_date, round(confidence, 2) AS confidence FROM tasks")
def dedupe_tasks(spark, d):
    return ex.rule_tasks(placed_docs(spark, d), KEY, NOW, P).select(
        "doc_id", F.col("pos._pos").cast("bigint").alias("pos"), "description", "assignee", "priority", stamp("due_date"),
        F.round("confidence", 2).alias("confidence"),
    )


_HINTS = f"""hint AS (SELECT doc_id, count(DISTINCT due) AS hint_count, min(due) AS hint FROM (
  SELECT doc_id, CASE found WHEN 'this' THEN '2024-03-22 09:30:00' WHEN 'that' THEN '2024-04-01 09:30:00' WHEN 'was' THEN '2024-03-31 00:00:00' END AS due,
    substr(text, CAST(greatest(start - 8, 0) AS BIGINT) + 1, CAST(start + length(found) + 8 - greatest(start - 8, 0) AS BIGINT)) AS around
  FROM (SELECT doc_id, text, found, sum(glen) OVER w + coalesce(sum(length(found)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, text, unnest(f) AS found, unnest(range(len(f))) AS i, unnest(list_transform(g[1:len(f)], lambda q: length(q))) AS glen FROM (
      SELECT doc_id, text, regexp_extract_all(text, '{P.due_hint}') AS f, string_split_regex(text, '{P.due_hint}') AS g FROM documents))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))) WHERE {sql_any('around', P.due_context)} GROUP BY 1)"""


def _bad(n: str) -> str:
    noise = (*P.refine_noise, *P.refine_function_words)
    return f"({n} IN {sql_list(P.refine_block)} OR {sql_any(n, noise)} OR NOT regexp_matches({n}, '^[A-Za-z\\x{{4e00}}-\\x{{9fff}}]{{2,8}}$'))"


def _refined(model_first: bool) -> str:
    link = f"contains(description, '{P.owner_link}')"
    intent = sql_any("description", P.refine_intents)
    verb = sql_any("description", P.refine_verbs)
    strict = "assignee0" if model_first else f"CASE WHEN {link} AND assignee0 = '' THEN regexp_extract(description, '{P.refine_strict_regex}', 1) ELSE assignee0 END"
    strict_ok = "true" if model_first else (
        f"(NOT {link} OR (regexp_extract(description, '{P.refine_strict_regex}', 1) <> '' AND NOT "
        + sql_any(f"trim(regexp_extract(description, '{P.refine_strict_regex}', 2), ' ，,')", P.refine_vague) + "))"
    )
    words = f"list_transform(regexp_extract_all(description, '{P.refine_word}'), lambda w: lower(w))"
    owner = f"nullif(regexp_extract(description, '{P.refine_owner_regex}', 1), '')"
    return f""", r0 AS (SELECT tasks.doc_id, pos, pattern, {sql_squeeze('description')} AS description, coalesce(assignee, '') AS assignee0, due_date, priority, confidence,
    hint_count, hint FROM tasks LEFT JOIN hint ON hint.doc_id = tasks.doc_id),
r1 AS (SELECT *, {strict} AS a1 FROM r0 WHERE NOT coalesce({_bad(owner)}, false) AND confidence >= {0.65 if model_first else 0.75}
  AND length(description) BETWEEN 8 AND 80 AND NOT {sql_any('description', P.refine_chatter)} AND ({f'{verb} OR {intent}' if model_first else verb}) AND {strict_ok}
  AND (len({words}) < 6 OR len(list_distinct({words})) / len({words}) >= 0.45)),
r2 AS (SELECT doc_id, pos, pattern, description, priority, confidence, CASE WHEN a1 = '' OR {_bad('a1')} THEN NULL ELSE a1 END AS assignee,
  coalesce(due_date, CASE WHEN hint_count = 1 AND ({link} OR {intent}) THEN hint END) AS due_date FROM r1),
r3 AS (SELECT *, regexp_replace(description, '[，。！？；:：]|{x.WS}', '', 'g') AS k FROM r2 WHERE (due_date IS NOT NULL OR assignee IS NOT NULL OR {intent})
  AND NOT (priority = 'low' AND due_date IS NULL AND assignee IS NULL) AND NOT regexp_matches(description, 'SPEAKER_|\\[|\\]')),
r4 AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY pos, pattern) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, pattern) AS rank, description, assignee, due_date, priority, round(confidence, 2) AS confidence
FROM r4 QUALIFY rank <= 12"""


def _refine(spark, d, model_first):
    corpus = placed_docs(spark, d)
    hints = ex.due_hints("text", NOW, P)
    one = corpus.select("doc_id", hints.alias("_h")).select("doc_id", F.size("_h").alias("hint_count"), F.get("_h", F.lit(0)).alias("hint"))
    out = ex.refine_tasks(ex.rule_tasks(corpus, KEY, NOW, P), KEY, one, P, model_first)
    return out.select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "description", "assignee", stamp("due_date"), "priority", F.round("confidence", 2).alias("confidence")
    )


@query("X06_refine_tasks", DEDUPED + ", " + _HINTS + _refined(False))
def refine_tasks(spark, d):
    return _refine(spark, d, False)


@query("X06_refine_tasks_model_first", DEDUPED + ", " + _HINTS + _refined(True))
def refine_tasks_model_first(spark, d):
    return _refine(spark, d, True)


@query("U02_hybrid_tasks", DEDUPED + f"""
, model AS (SELECT doc_id, title AS description, 0.9 AS confidence FROM (SELECT doc_id, substr(description, 1, 20) AS title FROM tasks WHERE confidence > 0.85)),
mkey AS (SELECT doc_id, regexp_replace(lower({sql_strip('description')}), '[，。！？、；:]|{x.WS}', '', 'g') AS k, 'model' AS src FROM model),
rkey AS (SELECT doc_id, k, 'rule' AS src FROM tasks)
SELECT 'hybrid' AS mode, doc_id, count(DISTINCT k) AS n FROM (SELECT * FROM mkey UNION ALL SELECT * FROM rkey) GROUP BY doc_id
UNION ALL SELECT 'llm_only', doc_id, count(DISTINCT k) FROM mkey GROUP BY doc_id
UNION ALL SELECT 'llm_first', doc_id, count(DISTINCT k) FROM (SELECT * FROM mkey UNION ALL SELECT * FROM rkey WHERE doc_id NOT IN (SELECT doc_id FROM mkey)) GROUP BY doc_id""")
def hybrid_tasks(spark, d):
    # written down: every mode reads them
    rules = durable(ex.rule_tasks(placed_docs(spark, d), KEY, NOW, P))
    model = rules.filter(F.col("confidence") > 0.85).withColumn("description", F.substring("description", 1, 20)).withColumn("confidence", F.lit(0.9))
    modes = [
        ex.hybrid_tasks(model, rules, KEY, m).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "doc_id", "n")
        for m in ("hybrid", "llm_only", "llm_first")
    ]
    return modes[0].unionAll(modes[1]).unionAll(modes[2])


# --- entities ----------------------------------------------------------------------------------------

_RUNS = f"regexp_extract_all(text, '{P.name_regex}')"
_NAMES = (
    f"list_concat(list_filter({_RUNS}, lambda n: regexp_matches(n, '^{P.surnames}') AND NOT list_contains({list(P.name_stop)}, n)), "
    + ", ".join(f"flatten(list_transform(regexp_extract_all(text, '({P.titled_surnames}){k}', 1), lambda n: [n || '{k}', n]))" for k in P.titles_kept)
    + ", " + ", ".join(f"regexp_extract_all(text, '({P.name_regex}){k}', 1)" for k in P.titles_dropped) + ")"
)
_ORGS = "list_filter(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in P.org_regexes) + "), lambda o: length(o) >= 2)"


@query("X01_extract_names", f"""
SELECT name, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(CASE WHEN len({_NAMES}) > 0 THEN {_NAMES}
  ELSE list_filter({_RUNS}[1:5], lambda n: regexp_matches(n, '^{P.surnames}')) END) AS name FROM documents) GROUP BY 1""")
def extract_names(spark, d):
    return docs(spark, d).select(F.explode(ex.names("text", P)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("X02_extract_orgs", f"SELECT org, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({_ORGS}) AS org FROM documents) GROUP BY 1")
def extract_orgs(spark, d):
    return docs(spark, d).select(F.explode(ex.organizations("text", P)).alias("org")).groupBy("org").agg(F.count(F.lit(1)).alias("n"))


def _offsets(regexes) -> str:
    one = """SELECT doc_id, found AS txt, CAST(start AS BIGINT) AS start, CAST(start + length(found) AS BIGINT) AS "end" FROM (
      SELECT doc_id, found, sum(glen) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(found)) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
        SELECT doc_id, unnest(f) AS found, unnest(range(len(f))) AS i, unnest(list_transform(g[1:len(f)], lambda q: length(q))) AS glen FROM (
          SELECT doc_id, regexp_extract_all(text, '%s') AS f, string_split_regex(text, '%s') AS g FROM documents)))"""
    return " UNION ALL ".join(one % (r, r) for r in regexes)


@query("X02_date_mentions", f"""
SELECT doc_id, txt, start, "end", CASE WHEN contains(txt, '-') THEN 'date' WHEN txt LIKE 'Q%' THEN 'quarter' ELSE 'relative' END AS kind
FROM ({_offsets(P.date_regexes)})
UNION ALL SELECT doc_id, txt, start, "end", 'quarter' FROM ({_offsets(P.time_regexes)}) WHERE txt LIKE 'Q%'""")
def date_mentions(spark, d):
    rows = placed_docs(spark, d).select("doc_id", F.explode(ex.date_mentions("text", NOW, P)).alias("m"))
    return rows.select("doc_id", F.col("m.text").alias("txt"), F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("end"), F.col("m.kind").alias("kind"))


@query("X02_time_expressions", f"""SELECT doc_id, txt, start, "end" FROM ({_offsets(P.time_regexes)})""")
def time_expressions(spark, d):
    rows = placed_docs(spark, d).select("doc_id", F.explode(ex.time_expressions("text", P)).alias("m"))
    return rows.select("doc_id", F.col("m.text").alias("txt"), F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("end"))


_SPANS = [
    f"SELECT {i} AS pattern, doc_id, txt, start, \"end\" FROM ({_offsets([p.replace('([^', '(?:[^').replace('([TOE]', '(?:[TOE]').replace('(to|', '(?:to|').replace('(the|', '(?:the|')])})"
    for i, p in enumerate(P.entity_task_regexes)
]


@query("X07_tasks_with_entities", f"""
SELECT doc_id, CAST(pattern AS BIGINT) AS pattern, {sql_strip('text')} AS description, start, "end", array_to_string(list_sort(list_distinct({_ORGS})), '|') AS organizations
FROM (SELECT doc_id, pattern, txt AS text, start, "end" FROM ({' UNION ALL '.join(_SPANS)}))""")
def tasks_with_entities(spark, d):
    out = ex.tasks_with_entities(placed_docs(spark, d), KEY, NOW, P)
    return out.select(
        "doc_id", F.col("pattern").cast("bigint").alias("pattern"), "description", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"), F.array_join(F.array_sort("organizations"), "|").alias("organizations"),
    )


_DATES = "list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in (*P.date_regexes, "Q[1-4]")) + ")"


@query("X08_entities", f"""
SELECT doc_id, entity, type, CAST(greatest(strpos(text, entity) - 1, 0) AS BIGINT) AS start, CAST(greatest(strpos(text, entity) - 1, 0) + length(entity) AS BIGINT) AS "end",
  CAST(CASE type WHEN 'PERSON' THEN 0.8 WHEN 'ORG' THEN 0.78 ELSE 0.82 END AS DOUBLE) AS confidence FROM (
  SELECT DISTINCT doc_id, text, {sql_strip('entity')} AS entity, type FROM (
    SELECT doc_id, text, unnest(CASE WHEN len({_NAMES}) > 0 THEN {_NAMES} ELSE list_filter({_RUNS}[1:5], lambda n: regexp_matches(n, '^{P.surnames}')) END) AS entity, 'PERSON' AS type FROM documents
    UNION ALL SELECT doc_id, text, unnest({_ORGS}), 'ORG' FROM documents
    UNION ALL SELECT doc_id, text, unnest({_DATES}), 'DATE' FROM documents)) WHERE entity <> ''""")
def entities(spark, d):
    return ex.entities(placed_docs(spark, d), KEY, NOW, pack=P).withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint"))


# --- summaries ------------------------------------------------------------------------------------------

_LEAD = f"array_to_string({PIECES}[1:3], '{P.stop_mark}')"


@query("X09_lead_summary", f"""
SELECT doc_id, CASE WHEN s <> '' AND NOT regexp_matches(s, '[.!?]$') THEN s || '.' ELSE s END AS summary FROM (SELECT doc_id, {_LEAD} AS s FROM documents)""")
def lead_summary(spark, d):
    return docs(spark, d).select("doc_id", su.lead_summary("text", 3, P).alias("summary"))


@query("X10_extractive_summary", f"""
WITH s AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS s, len(l) AS n FROM (SELECT doc_id, {PIECES} AS l FROM (SELECT doc_id, {sql_strip('text')} AS text FROM documents))),
w AS (SELECT doc_id, i, w, count(*) AS c FROM (SELECT doc_id, i, unnest(regexp_extract_all(s, '{P.token}')) AS w FROM s) GROUP BY ALL),
f AS (SELECT doc_id, w, sum(c) AS f FROM w GROUP BY ALL),
l AS (SELECT doc_id, i, sum(c * f) AS lex FROM w JOIN f USING (doc_id, w) GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(lex, 0) * 20 + n - s.i DESC, s.i) AS r FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND s.i = l.i),
k AS (SELECT doc_id, string_agg(s, '{P.stop_mark}' ORDER BY i) AS text, min(n) AS sentences, count(*) AS kept FROM r WHERE r <= greatest(1, floor(n * CAST(0.35 AS DOUBLE) + 0.5)) GROUP BY 1)
SELECT doc_id, CASE WHEN regexp_matches(text, '[.!?]$') THEN text ELSE text || '.' END AS summary, sentences, kept FROM k
UNION ALL SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, 0, 0
FROM (SELECT doc_id, {sql_strip('text')} AS text FROM documents) WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM k)""")
def extractive_summary(spark, d):
    return su.extractive_summary(docs(spark, d), pack=P)


def _clean(c: str = "text") -> str:
    return f"trim(regexp_replace({sql_tag(c)}, '{x.WS}+', ' ', 'g'), ' ')"


_SENTS = f"""sents AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rk FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS s FROM (
  SELECT doc_id, flatten(list_transform({PIECES}, lambda s: {_cut('s')})) AS l FROM (SELECT doc_id, {_clean()} AS text FROM documents))))"""


def _short(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substr({c}, 1, {n}), '，,。；; ') || '...' END"


_DEC = f"""decs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank, {_short('s', 70)} AS decision FROM (
  SELECT doc_id, i, {sql_strip('s')} AS s FROM sents) WHERE length(s) BETWEEN 8 AND 90 AND {sql_any('s', P.decision_marks)} QUALIFY rank <= 4)"""
_ISS = f"""issues AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank, {_short('s', 48)} AS issue FROM (
  SELECT doc_id, i, {sql_squeeze('s')} AS s FROM sents) WHERE length(s) BETWEEN 10 AND 50 AND NOT {sql_any('s', P.issue_noise)}
  AND NOT regexp_matches(s, '{"|".join(c * 5 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}')
  AND {sql_any('s', P.issue_marks)} AND {sql_any('s', P.issue_context)} QUALIFY rank <= 5)"""
_ACT = f"""acts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS rank, {_short(sql_strip('a'), 60)} AS action FROM (
  SELECT doc_id, i, j, o || '{P.action_link}' || {sql_strip('t')} || CASE WHEN due <> '' THEN '{P.due_open}' || due || '{P.due_close}' ELSE '' END AS a FROM (
    SELECT doc_id, i, regexp_extract(s, '{P.action_due_regex}', 1) AS due, unnest(regexp_extract_all(s, '{P.action_regex}', 1)) AS o,
      unnest(regexp_extract_all(s, '{P.action_regex}', 2)) AS t, unnest(range(len(regexp_extract_all(s, '{P.action_regex}', 1)))) AS j
    FROM (SELECT doc_id, i, {sql_strip('s')} AS s FROM sents) WHERE length(s) BETWEEN 6 AND 120)
  WHERE o NOT IN {sql_list(P.action_owner_block)}) QUALIFY rank <= 4)"""
_TOP = f"""freq AS (SELECT doc_id, w, count(*) AS n, min(i) AS fst FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM (
    SELECT doc_id, regexp_extract_all({_clean()}, '{P.keyword_token}') AS l FROM documents)) WHERE w NOT IN {sql_list(P.keyword_stop)} GROUP BY ALL),
top8 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fst) AS r FROM freq QUALIFY r <= 8)"""
_RULES = " UNION ALL ".join(
    f"SELECT doc_id, {r} AS pos, '{name}' AS name, list_filter({list(ws)}, lambda w: contains(text, w))[1:4] AS kws FROM clean"
    for r, (name, ws) in enumerate(P.topic_rules)
)
_TOPICS = f"""clean AS (SELECT doc_id, {_clean()} AS text FROM documents), {_TOP},
ruled AS (SELECT * FROM ({_RULES}) WHERE len(kws) > 0),
few AS (SELECT doc_id FROM documents WHERE (SELECT count(*) FROM ruled WHERE ruled.doc_id = documents.doc_id) < 2),
filled AS (SELECT * FROM ruled UNION ALL SELECT doc_id, r + {len(P.topic_rules)}, w, [w] FROM top8 WHERE w NOT IN {sql_list(P.topic_skip)} AND doc_id IN (SELECT doc_id FROM few)),
topics AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank, name, kws FROM filled QUALIFY rank <= 5)"""


@query("X12_rule_topics", f"WITH {_TOPICS} SELECT doc_id, rank, name, array_to_string(kws, '|') AS keywords FROM topics")
def rule_topics(spark, d):
    out = su.rule_topics(placed_docs(spark, d), KEY, P)
    return out.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "name", F.array_join("keywords", "|").alias("keywords"))


@query("X13_decisions", f"WITH {_SENTS}, {_DEC} SELECT * FROM decs")
def decisions(spark, d):
    return su.decisions(su.sentence_rows(placed_docs(spark, d), KEY, P), KEY, P).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "decision")


@query("X14_open_issues", f"WITH {_SENTS}, {_ISS} SELECT * FROM issues")
def open_issues(spark, d):
    return su.open_issues(su.sentence_rows(placed_docs(spark, d), KEY, P), KEY, P).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "issue")


@query("X15_action_clues", f"WITH {_SENTS}, {_ACT} SELECT * FROM acts")
def action_clues(spark, d):
    return su.action_clues(su.sentence_rows(placed_docs(spark, d), KEY, P), KEY, P).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "action")


_TODO, _DECIDED = (p.replace("%d", "") for p in P.summary_parts[1:])
_PARTS_X11 = f"""p AS (SELECT doc_id, (SELECT string_agg(name, '、' ORDER BY rank) FROM topics q WHERE q.doc_id = d.doc_id AND rank <= 3) AS names,
  (SELECT count(*) FROM topics q WHERE q.doc_id = d.doc_id) AS topics, (SELECT count(*) FROM acts q WHERE q.doc_id = d.doc_id) AS actions,
  (SELECT count(*) FROM decs q WHERE q.doc_id = d.doc_id) AS decisions, (SELECT count(*) FROM issues q WHERE q.doc_id = d.doc_id) AS issues,
  (SELECT string_agg({_short(sql_strip('s'), 60)}, '；' ORDER BY i) FROM sents q WHERE q.doc_id = d.doc_id AND rk <= 2) AS lead FROM documents d),
q AS (SELECT *, list_filter([CASE WHEN topics > 0 THEN '{P.summary_parts[0].replace("%s", "")}' || names END, CASE WHEN actions > 0 THEN actions || '{_TODO}' END,
  CASE WHEN decisions > 0 THEN decisions || '{_DECIDED}' END], lambda v: v IS NOT NULL) AS l FROM p),
r AS (SELECT *, CASE WHEN len(l) = 0 AND lead IS NOT NULL THEN [lead] ELSE l END AS parts FROM q),
u AS (SELECT *, {sql_strip("array_to_string(list_transform(parts, lambda v: trim(v, '。； ')), '。')")} AS a,
  {sql_strip("array_to_string(list_transform(parts[1:2], lambda v: trim(v, '。 ')), '；')")} AS b FROM r),
v AS (SELECT *, {_short('a', 220)} AS a2, {_short('b', 120)} AS b2 FROM u),
y AS (SELECT *, CASE WHEN a2 <> '' AND a2 NOT LIKE '%。' THEN a2 || '。' ELSE a2 END AS summary, CASE WHEN b2 <> '' AND b2 NOT LIKE '%。' THEN b2 || '。' ELSE b2 END AS brief FROM v)"""
_X11 = f"""WITH {_SENTS}, {_DEC}, {_ISS}, {_ACT}, {_TOPICS}, {_PARTS_X11}
SELECT doc_id, topics, decisions, issues, actions, summary, CASE WHEN brief = '' THEN summary ELSE brief END AS executive_summary FROM y"""


@query("X11_structured_summary", _X11)
def structured_summary(spark, d):
    n = lambda c, name: F.size(c).cast("bigint").alias(name)
    return su.structured_summary(placed_docs(spark, d), KEY, P).select(
        "doc_id", n("topics", "topics"), n("decisions", "decisions"), n("open_issues", "issues"), n("actions", "actions"), "summary", "executive_summary"
    )


# --- keywords and topics ------------------------------------------------------------------------------------

@query("A18_O03_top_tokens", f"""
WITH f AS (SELECT doc_id, w AS token, count(*) AS n, min(i) AS fst FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM (
  SELECT doc_id, regexp_extract_all(text, '{P.topic_token}') AS l FROM documents)) WHERE w NOT IN {sql_list(P.topic_stop)}
  AND lower(w) NOT IN {sql_list(P.topic_stop_lower)} AND {VALID_TOPIC.format(c='w')} GROUP BY ALL)
SELECT doc_id, token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fst) AS rank FROM f QUALIFY rank <= 5""")
def top_tokens(spark, d):
    return tp.text_topics(placed_docs(spark, d), KEY, 5, P).select("doc_id", "token", "n", F.col("rank").cast("bigint").alias("rank"))


@query("A18_top_tokens_by_source", f"""
WITH f AS (SELECT source, w AS token, count(*) AS n, min({{'d': doc_id, 'i': i}}) AS fst FROM (
  SELECT source, doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT source, doc_id, regexp_extract_all(text, '{P.token}') AS l FROM documents))
  WHERE lower(w) NOT IN {sql_list(P.stopwords)} GROUP BY ALL)
SELECT source, token, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, fst) AS rank FROM f QUALIFY rank <= 10""")
def top_tokens_by_source(spark, d):
    texts = docs(spark, d).withColumn("seg_no", F.col("doc_id"))
    return su.top_tokens(texts, ["source"], 10, P, lower_stop=P.stopwords).select("source", "token", "n", F.col("rank").cast("bigint").alias("rank"))


_WORDS = f"list_filter(list_transform(regexp_extract_all(text, '{P.token}'), lambda w: lower(w)), lambda w: w NOT IN {sql_list(P.stopwords)})"
_TFIDF = f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS token FROM documents) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
kw AS (SELECT doc_id, token, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS score FROM tf JOIN dfs USING (token)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, token) AS rank FROM kw QUALIFY rank <= 10)"""


@query("K08_tfidf_keywords", f"WITH {_TFIDF} SELECT doc_id, rank, token, round(score, 4) AS score FROM ranked")
def tfidf_keywords(spark, d):
    return tp.tfidf_keywords(docs(spark, d), pack=P).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "token", F.round("score", 4).alias("score"))


@query("K04_keyword_topics", f"""WITH {_TFIDF}
SELECT doc_id, (rank - 1) // 3 AS topic, arg_min(token, rank) AS name, string_agg(token, '|' ORDER BY rank) AS keywords, round(avg(score), 4) AS score
FROM ranked WHERE rank <= 6 GROUP BY ALL""")
def keyword_topics(spark, d):
    out = tp.keyword_topics(tp.tfidf_keywords(docs(spark, d), pack=P), KEY, 2)
    return out.select("doc_id", F.col("topic").cast("bigint").alias("topic"), "name", F.array_join("keywords", "|").alias("keywords"), "score")


@query("K05_name_topics", f"""WITH {_TFIDF}, c AS (SELECT doc_id % 12 AS topic, token, count(*) AS n FROM (
    SELECT doc_id, unnest({_WORDS}) AS token FROM documents) GROUP BY ALL),
b AS (SELECT doc_id % 12 AS topic, arg_max(token, {{'s': score, 't': token}}) AS k FROM ranked GROUP BY 1),
m AS (SELECT topic, token FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, token) = 1)
SELECT topic, coalesce(k, token, '主题_' || topic) AS name FROM (SELECT DISTINCT doc_id % 12 AS topic FROM documents) LEFT JOIN b USING (topic) LEFT JOIN m USING (topic)""")
def name_topics(spark, d):
    texts = docs(spark, d).withColumn("topic", F.col("doc_id") % 12)
    kw = tp.tfidf_keywords(docs(spark, d), pack=P).select((F.col("doc_id") % 12).alias("topic"), F.col("token").alias("keyword"), "score")
    return tp.name_topics(kw, texts, pack=P)


@query("K06_representatives", f"""WITH {_TFIDF}, tops AS (SELECT doc_id, (rank - 1) // 3 AS topic, list(token) AS kws FROM ranked WHERE rank <= 6 GROUP BY ALL),
s AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {PIECES} AS l FROM documents)),
j AS (SELECT doc_id, topic, pos, sentence, len(list_filter(kws, lambda w: contains(sentence, w))) / len(kws) AS relevance FROM s JOIN tops USING (doc_id))
SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id, topic ORDER BY relevance DESC, pos) AS rank, sentence, round(relevance, 4) AS relevance
FROM j WHERE relevance > 0 QUALIFY rank <= 3""")
def representatives(spark, d):
    corpus = docs(spark, d)
    topics = tp.keyword_topics(tp.tfidf_keywords(corpus, pack=P), KEY, 2)
    out = tp.representatives(su.sentence_rows(corpus, KEY, P, None), topics, KEY)
    return out.select("doc_id", F.col("topic").cast("bigint").alias("topic"), F.col("rank").cast("bigint").alias("rank"), "sentence", F.round("relevance", 4).alias("relevance"))


_ROUNDS = 10
_RANKS = ", ".join(
    f"r{i + 1} AS MATERIALIZED (SELECT e.doc_id, e.b AS t, 0.15 + 0.85 * sum(e.share * r.s) AS s FROM e JOIN r{i} r ON r.doc_id = e.doc_id AND r.t = e.a GROUP BY ALL)"
    for i in range(_ROUNDS)
)


@query("K07_stopwords", f"""
SELECT doc_id, len(all_words) AS words, len(list_filter(all_words, lambda w: w NOT IN {sql_list(P.stopwords)})) AS kept
FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{P.token}'), lambda w: lower(w)) AS all_words FROM documents)""")
def stopwords(spark, d):
    return docs(spark, d).select(
        "doc_id", F.size(x.tokens("text", P)).cast("bigint").alias("words"), F.size(tp.keyword_tokens("text", P)).cast("bigint").alias("kept")
    )


_RANK = f"""w AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (
  SELECT doc_id, list_transform(regexp_extract_all(text, '{P.token}'), lambda w: lower(w)) AS l FROM documents)),
k AS (SELECT * FROM w WHERE t NOT IN {sql_list(P.stopwords)}),
one AS (SELECT x.doc_id, x.t AS a, y.t AS b FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i + 1 AND x.i + 4),
g AS (SELECT doc_id, a, b, count(*) AS w FROM (SELECT doc_id, a, b FROM one UNION ALL SELECT doc_id, b, a FROM one) GROUP BY ALL),
e AS MATERIALIZED (SELECT doc_id, a, b, w / sum(w) OVER (PARTITION BY doc_id, a) AS share FROM g),
r0 AS (SELECT doc_id, a AS t, 1.0 / count(*) OVER (PARTITION BY doc_id) AS s FROM (SELECT DISTINCT doc_id, a FROM e)), {_RANKS},
z AS (SELECT doc_id, t, (s - min(s) OVER v / 10) / (max(s) OVER v - min(s) OVER v / 10) AS s FROM r{_ROUNDS} WINDOW v AS (PARTITION BY doc_id))"""


@query("K01_textrank", f"""WITH {_RANK}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, t) AS rank, t AS keyword, round(s, 4) AS score FROM z QUALIFY rank <= 5""")
def textrank(spark, d):
    return tp.textrank(docs(spark, d), k=5, pack=P).withColumn("score", F.round("score", 4))


@query("K02_lda_topics")
def lda_topics(spark, d):
    return tp.lda_topics(docs(spark, d), 5, 1000, P)


@query("K03_cluster_documents")
def cluster_documents(spark, d):
    return tp.cluster_documents(docs(spark, d), 5, pack=P)


_EVO = f"""f AS (SELECT lang, source, lower(w) AS token, count(*) AS n FROM (SELECT lang, source, unnest(regexp_extract_all(text, '{P.topic_token}')) AS w FROM documents)
  WHERE lower(w) NOT IN {sql_list(P.stopwords)} GROUP BY ALL),
t AS (SELECT lang, source, token FROM f WHERE n >= 2),
p AS (SELECT lang, source, list_sort(list(token)) AS now FROM t GROUP BY ALL),
q AS (SELECT *, lag(source) OVER w AS prev, lag(now) OVER w AS was FROM p WINDOW w AS (PARTITION BY lang ORDER BY source))"""


@query("W09_U03_topic_evolution", f"""WITH {_EVO}
SELECT lang, prev AS from_period, source AS to_period, array_to_string(list_sort(list_filter(now, lambda v: NOT list_contains(was, v)))[1:5], '|') AS new_topics,
  array_to_string(list_sort(list_filter(was, lambda v: NOT list_contains(now, v)))[1:5], '|') AS disappeared_topics,
  array_to_string(list_sort(list_filter(now, lambda v: list_contains(was, v)))[1:5], '|') AS persistent_topics FROM q WHERE prev IS NOT NULL""")
def topic_evolution(spark, d):
    words = docs(spark, d).select("lang", "source", F.explode(x.tokens("text", P, "topic")).alias("token")).withColumn("token", F.lower("token"))
    counts = words.filter(~F.col("token").isin(*P.stopwords)).groupBy("lang", "source", "token").agg(F.count(F.lit(1)).alias("n"))
    # a period's topics are all words it has at least twice
    out = tp.topic_evolution(counts.filter(F.col("n") >= 2), "source", ["lang"])
    return out.select("lang", "from_period", "to_period", *[F.array_join(c, "|").alias(c) for c in ("new_topics", "disappeared_topics", "persistent_topics")])


@query("U03_shared_vocabulary", f"""
WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '{P.token}'))) AS token FROM documents)
SELECT 'only_en' AS part, token FROM (SELECT token FROM w WHERE lang = 'en' EXCEPT SELECT token FROM w WHERE lang = 'de')
UNION ALL SELECT 'both', token FROM (SELECT token FROM w WHERE lang = 'en' INTERSECT SELECT token FROM w WHERE lang = 'de')""")
def shared_vocabulary(spark, d):
    words = docs(spark, d).select("lang", F.explode(x.tokens("text", P)).alias("token")).withColumn("token", F.lower("token"))
    en, de = (words.filter(F.col("lang") == v).select("token") for v in ("en", "de"))
    return en.subtract(de).select(F.lit("only_en").alias("part"), "token").unionAll(en.intersect(de).select(F.lit("both").alias("part"), "token"))


@query("U04_sanitize_topics", f"""
WITH r AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
v AS (SELECT doc_id, pos, {sql_strip('raw')} AS name FROM r), ok AS (SELECT * FROM v WHERE {VALID_TOPIC.format(c=f"trim(name, ' ，,.:;:!?！？。；【】[]()（）" + chr(34) + "')")}),
f AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pos) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank, name FROM f QUALIFY rank <= 5""")
def sanitize_topics(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "name"))
    rows = rows.withColumn("keywords", F.array("name", F.lower("name")))
    return tp.sanitize_topics(rows, KEY, 5, P).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "name")


@query("O07_topic_series", f"""WITH {_TFIDF}
SELECT doc_id, topic, name, confidence, string_agg(token, ', ' ORDER BY rank) AS keywords, any_value(topic % 3) AS participants, confidence * 50 AS size FROM (
  SELECT doc_id, rank, token, (rank - 1) // 3 AS topic, first_value(token) OVER (PARTITION BY doc_id, (rank - 1) // 3 ORDER BY rank) AS name,
    ((rank - 1) // 3 + 1) / 10 AS confidence FROM ranked WHERE rank <= 9) GROUP BY doc_id, topic, name, confidence""")
def topic_series(spark, d):
    topics = tp.keyword_topics(tp.tfidf_keywords(docs(spark, d), pack=P), KEY, 3).withColumn("topic", F.col("topic").cast("bigint"))
    people = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("topic") % 3).cast("int"))
    rows = topics.withColumn("confidence", (F.col("topic") + 1) / 10).withColumn("speaker_involved", people)
    return tp.topic_series(rows).select("doc_id", "topic", "name", "confidence", "keywords", "participants", "size")


@query("A14_keyword_hits", """
SELECT doc_id, array_to_string(h, '|') AS hits, len(h) AS hit_count, round(len(h) / 5, 3) AS hit_ratio FROM (
  SELECT doc_id, list_filter(['that', 'License', 'und', 'que', '555'], lambda w: contains(text, w)) AS h FROM documents)""")
def keyword_hits(spark, d):
    out = tp.keyword_hits(docs(spark, d), ["that", "License", "und", "que", "555"])
    return out.select("doc_id", F.array_join("hits", "|").alias("hits"), "hit_count", "hit_ratio")


@query("U07_merge_labels", f"""
SELECT doc_id, (SELECT string_agg(v, '|' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(l) AS v, unnest(range(len(l))) AS i) WHERE v <> '' GROUP BY v)) AS labels
FROM (SELECT doc_id, list_transform(list_concat(a, b), lambda w: {sql_strip('w')}) AS l FROM (
  SELECT doc_id, string_split(text, ' ') AS a, {PIECES} AS b FROM documents))""")
def merge_labels(spark, d):
    rows = docs(spark, d).select("doc_id", F.split("text", " ").alias("a"), x.sentences("text", P).alias("b"))
    return rows.select("doc_id", F.array_join(tp.merge_labels(F.col("a"), F.col("b")), "|").alias("labels"))


@query("X16_resolve_topics", f"""WITH {_TFIDF},
st AS (SELECT doc_id, string_agg(token, '|' ORDER BY rank) AS l FROM ranked WHERE doc_id IN (SELECT doc_id FROM labels) AND rank <= 3 GROUP BY 1),
fq AS (SELECT doc_id, w, count(*) AS n, min(i) AS fst FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM (
  SELECT doc_id, regexp_extract_all(text, '{P.topic_token}') AS l FROM documents)) WHERE w NOT IN {sql_list(P.topic_stop)}
  AND lower(w) NOT IN {sql_list(P.topic_stop_lower)} AND {VALID_TOPIC.format(c='w')} GROUP BY ALL),
tx AS (SELECT doc_id, string_agg(w, '|' ORDER BY r) AS l FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fst) AS r FROM fq QUALIFY r <= 5) GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN st.l IS NOT NULL THEN 0 WHEN tx.l IS NOT NULL THEN 1 END AS BIGINT) AS source, coalesce(st.l, tx.l) AS topics
FROM documents d LEFT JOIN st ON st.doc_id = d.doc_id LEFT JOIN tx ON tx.doc_id = d.doc_id""")
def resolve_topics(spark, d):
    corpus = docs(spark, d)
    labelled = t.load(spark, d, "labels").select("doc_id")
    stored = tp.tfidf_keywords(corpus, k=3, pack=P).join(labelled, "doc_id", "left_semi").select("doc_id", "rank", F.col("token").alias("name"))
    text = tp.text_topics(corpus, KEY, 5, P).select("doc_id", "rank", F.col("token").alias("name"))
    return tp.resolve_topics(corpus, KEY, [stored, text]).select("doc_id", F.col("source").cast("bigint").alias("source"), F.array_join("topics", "|").alias("topics"))


# the words of a text are its stored topics, its words by graph rank its analysed ones; one document in seven per level
def _tokens_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT doc_id, string_agg(w, '|' ORDER BY r) AS l FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS r FROM (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(text, '{P.topic_token}') AS l FROM {source}))
  WHERE w NOT IN {sql_list(P.topic_stop)} AND lower(w) NOT IN {sql_list(P.topic_stop_lower)} AND {VALID_TOPIC.format(c='w')} GROUP BY doc_id, w QUALIFY r <= 5) GROUP BY 1)"""


_TRIMMED = "trim(name, ' ，,.:;:!?！？。；【】[]()（）" + chr(34) + "')"
_CLEAN_TOPICS = """{to} AS (SELECT doc_id, string_agg(name, '|' ORDER BY pos) AS l FROM (SELECT * FROM (SELECT * FROM {of} WHERE {valid}
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pos) = 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5) GROUP BY 1)"""


@query("X16_topic_cascade", f"""WITH given AS (SELECT doc_id, text, doc_id % 7 AS k FROM documents),
st AS (SELECT doc_id, pos, {sql_strip('raw')} AS name FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, ' ') AS l FROM given WHERE k = 0))),
{_CLEAN_TOPICS.format(to="l0", of="st", valid=VALID_TOPIC.format(c=_TRIMMED))},
said AS (SELECT doc_id, CASE WHEN k IN (0, 4, 5) THEN text WHEN k = 1 THEN regexp_extract(text, '[A-Za-z]{{4,20}}') END AS text FROM given),
documents AS (SELECT * FROM said WHERE text IS NOT NULL), {_RANK},
best AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, t) - 1) AS pos, t AS name FROM z),
heads AS (SELECT * FROM best WHERE pos % 3 = 0 AND pos < 15), {_CLEAN_TOPICS.format(to="l1", of="heads", valid=VALID_TOPIC.format(c=_TRIMMED))},
items AS (SELECT doc_id, text FROM given WHERE k = 2), notes AS (SELECT doc_id, text FROM given WHERE k = 3),
{_tokens_sql("l2", "said")}, {_tokens_sql("l3", "items")}, {_tokens_sql("l4", "notes")}
SELECT g.doc_id, CAST(CASE WHEN l0.l IS NOT NULL THEN 0 WHEN l1.l IS NOT NULL THEN 1 WHEN l2.l IS NOT NULL THEN 2 WHEN l3.l IS NOT NULL THEN 3 WHEN l4.l IS NOT NULL THEN 4 END AS BIGINT) AS source,
  coalesce(l0.l, l1.l, l2.l, l3.l, l4.l) AS topics
FROM given g LEFT JOIN l0 USING (doc_id) LEFT JOIN l1 USING (doc_id) LEFT JOIN l2 USING (doc_id) LEFT JOIN l3 USING (doc_id) LEFT JOIN l4 USING (doc_id)""")
def topic_cascade(spark, d):
    corpus, k = placed_docs(spark, d).select("doc_id", "text"), F.col("doc_id") % 7
    said = corpus.withColumn("text", F.when(k.isin(0, 4, 5), F.col("text")).when(k == 1, F.regexp_extract("text", "[A-Za-z]{4,20}", 0))).filter(F.col("text").isNotNull())
    stored = corpus.filter(k == 0).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "name"))
    stored = stored.withColumn("keywords", F.array("name"))
    of = lambda rows: lambda left: rows.join(left, KEY, "left_semi")
    tokens = lambda texts: lambda left: tp.as_topics(tp.text_topics(of(texts)(left), KEY, 5, P), KEY)
    levels = [
        (of(stored), True), (lambda left: tp.analysed_topics(of(said)(left), "doc_id", 5, P), True),
        (tokens(said), False), (tokens(corpus.filter(k == 2)), False), (tokens(corpus.filter(k == 3)), False),
    ]
    rows = tp.cascade_topics(corpus, KEY, levels, 5, P)
    return rows.select("doc_id", F.col("source").cast("bigint").alias("source"), F.array_join("topics.name", "|").alias("topics"))


# --- speakers --------------------------------------------------------------------------------------------------

def _features(spark, d):
    return t.features(spark, d).withColumn("meeting_id", F.lit(0).cast("bigint") + F.floor(F.col("chunk_id") / 5)).select(
        "meeting_id", "chunk_id", "local_speaker", "vec"
    )


_FEATS = """f AS (SELECT chunk_id // 5 AS meeting_id, chunk_id, speaker, list(m ORDER BY dim) AS vec FROM (
  SELECT chunk_id, speaker, dim, avg(v) AS m FROM (SELECT vec_id // 50 AS chunk_id, CAST(label AS BIGINT) AS speaker,
    unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY ALL) GROUP BY ALL)"""
_PAIRS = """pairs AS (SELECT a.meeting_id, a.chunk_id, a.speaker, b.speaker AS previous,
  (list_cosine_similarity(a.vec, b.vec) + 1) / 2 AS similarity FROM f a JOIN f b ON a.meeting_id = b.meeting_id AND a.chunk_id = b.chunk_id + 1)"""


@query("J04_pair_similarity", f"WITH {_FEATS}, {_PAIRS} SELECT meeting_id, chunk_id, speaker, previous, round(similarity, 6) AS similarity FROM pairs")
def pair_similarity(spark, d):
    return sp.pair_similarity(_features(spark, d)).withColumn("similarity", F.round("similarity", 6))


# the pairs of a chunk from the best on, one a step, with who is taken on either side; then the links from root to root
_J05 = f"""WITH RECURSIVE {_FEATS}, {_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, chunk_id ORDER BY similarity DESC, speaker, previous) AS k FROM pairs WHERE similarity >= 0.55),
g AS (SELECT DISTINCT meeting_id, chunk_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS used FROM ranked UNION ALL
  SELECT r.meeting_id, r.chunk_id, r.k, CASE WHEN list_contains(taken, speaker) OR list_contains(used, previous) THEN taken ELSE list_append(taken, speaker) END,
    CASE WHEN list_contains(taken, speaker) OR list_contains(used, previous) THEN used ELSE list_append(used, previous) END
  FROM g JOIN ranked r ON r.meeting_id = g.meeting_id AND r.chunk_id = g.chunk_id AND r.k = g.k + 1),
done AS (SELECT meeting_id, chunk_id, unnest(taken) AS speaker, unnest(used) AS previous FROM g QUALIFY row_number() OVER (PARTITION BY meeting_id, chunk_id ORDER BY k DESC) = 1),
t AS (SELECT meeting_id, chunk_id, speaker, chunk_id AS root_chunk, speaker AS root FROM f WHERE NOT EXISTS (
    SELECT 1 FROM done WHERE done.meeting_id = f.meeting_id AND done.chunk_id = f.chunk_id AND done.speaker = f.speaker) UNION ALL
  SELECT d.meeting_id, d.chunk_id, d.speaker, root_chunk, root FROM t JOIN done d ON d.meeting_id = t.meeting_id AND d.chunk_id = t.chunk_id + 1 AND d.previous = t.speaker)
SELECT meeting_id, chunk_id, speaker, printf('SPK_%03d', dense_rank() OVER (PARTITION BY meeting_id ORDER BY root_chunk, root) - 1) AS global_speaker FROM t"""

# one chunk of a meeting a step, with the last five vectors of every speaker known by then
_MEAN = "list_transform(range(1, len(k.recent[1]) + 1), lambda i: list_avg(list_transform(k.recent, lambda r: r[i])))"
_J06 = f"""WITH RECURSIVE {_FEATS},
ch AS (SELECT meeting_id, chunk_id, row_number() OVER (PARTITION BY meeting_id ORDER BY chunk_id) AS place, list({{'s': speaker, 'v': vec}} ORDER BY speaker) AS said FROM f GROUP BY meeting_id, chunk_id),
t AS (SELECT DISTINCT meeting_id, CAST(NULL AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(s BIGINT, v DOUBLE[])[]) AS said, CAST([] AS BIGINT[]) AS numbers,
    CAST([] AS STRUCT(n BIGINT, recent DOUBLE[][])[]) AS known FROM ch UNION ALL
  SELECT meeting_id, chunk_id, place, said, numbers, list_transform(range(0, greatest(len(known), list_max(numbers) + 1)), lambda n: {{'n': n, 'recent': CASE
      WHEN list_position(numbers, n) IS NULL THEN known[n + 1].recent WHEN n >= len(known) THEN [said[list_position(numbers, n)].v]
      ELSE list_append(known[n + 1].recent, said[list_position(numbers, n)].v)[-5:] END}})
  FROM (SELECT *, list_transform(kept, lambda b, i: coalesce(b, len(known) + len(list_filter(kept[1:i - 1], lambda z: z IS NULL)))) AS numbers
    FROM (SELECT *, list_transform(best, lambda b, i: CASE WHEN b IS NOT NULL AND NOT list_contains(best[1:i - 1], b) THEN b END) AS kept
      FROM (SELECT c.*, known, list_transform(c.said, lambda x: list_sort(list_filter(list_transform(known, lambda k:
          {{'d': -(list_cosine_similarity(x.v, {_MEAN}) + 1) / 2, 'n': k.n}}), lambda q: q.d <= -0.55))[1].n) AS best
        FROM t JOIN ch c ON c.meeting_id = t.meeting_id AND c.place = t.place + 1))))
SELECT meeting_id, chunk_id, speaker, printf('SPEAKER_%02d', number) AS global_speaker
FROM (SELECT meeting_id, chunk_id, unnest(list_transform(said, lambda x: x.s)) AS speaker, unnest(numbers) AS number FROM t WHERE place > 0)"""


@query("J05_track_speakers", _J05)
def track_speakers(spark, d):
    return sp.track_speakers(_features(spark, d), 0.55)


@query("J06_best_candidates", f"""WITH {_FEATS}, {_PAIRS},
top AS (SELECT * FROM pairs WHERE similarity >= 0.55 QUALIFY row_number() OVER (PARTITION BY meeting_id, chunk_id, speaker ORDER BY similarity DESC, previous) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, chunk_id, previous ORDER BY speaker) AS claim FROM top)
SELECT DISTINCT p.meeting_id, p.chunk_id, p.speaker, CASE WHEN claim = 1 THEN c.previous END AS previous, round(c.similarity, 6) AS similarity
FROM pairs p LEFT JOIN c ON c.meeting_id = p.meeting_id AND c.chunk_id = p.chunk_id AND c.speaker = p.speaker""")
def best_candidates(spark, d):
    return sp.best_candidates(sp.pair_similarity(_features(spark, d)), 0.55).withColumn("similarity", F.round("similarity", 6))


@query("J06_track_speakers_best", _J06)
def track_speakers_best(spark, d):
    return sp.track_speakers(_features(spark, d), 0.55, "best")


@query("J06_rolling_profile", f"""WITH {_FEATS}, v AS (SELECT meeting_id, speaker, chunk_id, unnest(range(len(vec))) AS dim, unnest(vec) AS value FROM f)
SELECT meeting_id, speaker AS local_speaker, chunk_id, dim, round(avg(value) OVER (PARTITION BY meeting_id, speaker, dim ORDER BY chunk_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value FROM v""")
def rolling_profile(spark, d):
    return sp.rolling_profile(_features(spark, d)).withColumn("value", F.round("value", 6)).withColumn("dim", F.col("dim").cast("bigint"))


