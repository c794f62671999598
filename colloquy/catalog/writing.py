"""Queries that apply text and date rules to the documents and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.speech import LOW, MARKED, NORM, REPEATED, sql_list, sql_squeeze, sql_strip
from colloquy.catalog.views import TASKS, with_
from colloquy.functions import dates, text as x
from colloquy.operators import segments as seg_ops
from colloquy.packs import PROSE, DuePhrase
from colloquy.plans.hot import place_texts
from colloquy.sources import tables as t

P = PROSE
PIECES = f"list_filter(list_transform(string_split_regex(coalesce(text, ''), '{P.sentence_break}'), lambda s: trim(s, '{P.trim_chars}')), lambda s: s <> '')"
FMT = "yyyy-MM-dd HH:mm:ss"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def docs(spark, d):
    return t.corpus(spark, d)


def placed_docs(spark, d):
    """The documents placed by key, some megabytes of text to a task: a file is read by as many tasks as it has row groups, too few to take texts apart."""
    return place_texts(docs(spark, d), "doc_id")


def exploded(df, arr, name):
    return df.select("doc_id", F.posexplode(arr).alias("pos", name)).withColumn("pos", F.col("pos").cast("bigint"))


def unnested(lst: str, name: str, source: str = "documents") -> str:
    return f"SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS {name} FROM (SELECT doc_id, {lst} AS l FROM {source})"


@query("T01_sentences", unnested(PIECES, "sentence"))
def sentences(spark, d):
    return exploded(docs(spark, d), x.sentences("text", P), "sentence")


def _cut(s: str) -> str:
    clause = (
        f"list_filter(list_transform(string_split_regex({s}, '{P.clause_break}'), lambda c: trim(c, '{P.trim_chars}')), lambda c: c <> '')"
    )
    hard = (
        "flatten(list_transform(" + clause + ", lambda c: CASE WHEN length(c) <= 80 THEN [c] ELSE list_filter(list_transform("
        f"range(0, length(c), 70), lambda i: trim(substr(c, i + 1, 70), '{P.trim_chars}')), lambda q: q <> '') END))"
    )
    return f"CASE WHEN length({s}) <= 80 THEN [{s}] ELSE {hard} END"


@query("T02_short_sentences", unnested(f"flatten(list_transform({PIECES}, lambda s: {_cut('s')}))", "sentence"))
def short_sentences(spark, d):
    return exploded(docs(spark, d), x.sentences("text", P, max_len=80), "sentence")


def sql_tag(c: str) -> str:
    return f"regexp_replace({c}, '{x.SPEAKER_TAG}', '', 'g')"


def sql_task(c: str) -> str:
    bare = f"regexp_replace({sql_tag(c)}, '(?i)(^|[^A-Za-z0-9_])SPEAKER_\\d+', '\\1', 'g')"
    body = f"trim(regexp_replace({bare}, '{x.WS}+', ' ', 'g'), ' ，,。；;:：')"
    return f"regexp_replace({body}, '^{x.any_of(P.lead_fillers)}{x.WS}*', '')"


CANDIDATES = (
    f"list_filter(list_transform(flatten(list_transform(list_transform(string_split_regex(coalesce(text, ''), '{P.sentence_break}'), "
    f"lambda s: {sql_task('s')}), lambda s: string_split_regex(s, '{P.clause_break}'))), lambda s: {sql_task('s')}), lambda s: s <> '')"
)


@query("T03_task_candidates", unnested(CANDIDATES, "candidate"))
def task_candidates(spark, d):
    return exploded(docs(spark, d), x.task_candidates("text", P), "candidate")


_TAGGED = "'[SPEAKER_0' || (doc_id % 3) || ']  ' || text"


def tagged(spark, d):
    tag = F.concat(F.lit("[SPEAKER_0"), (F.col("doc_id") % 3).cast("string"), F.lit("]  "), F.col("text"))
    return docs(spark, d).withColumn("text", tag)


@query("T04_strip_tags", f"SELECT doc_id, {sql_squeeze(sql_tag(_TAGGED))} AS text FROM documents")
def strip_tags(spark, d):
    return tagged(spark, d).select("doc_id", x.strip_tags("text").alias("text"))


@query("T05_normalize_task", f"SELECT doc_id, {sql_task(_TAGGED)} AS text FROM documents")
def normalize_task(spark, d):
    return tagged(spark, d).select("doc_id", x.normalize_task("text", P).alias("text"))


def sql_rules(rules, c: str) -> str:
    for pattern, new in rules:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


_PLAIN_RULES = [r for r in x.clean_rules(P) if "\\1" not in r[0]]
_AT = next(i for i, r in enumerate(x.clean_rules(P)) if "\\1" in r[0])
_PLAIN_RULES[_AT:_AT] = [(f"{m}{m}+", m) for m in "。？！；，"]
_MARK = (
    "list_transform(string_split({}, ' '), lambda s: CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '[。？！；…]$') THEN s "
    f"WHEN regexp_matches(s, '{x.any_of(P.question_words)}') THEN s || '？' ELSE s || '。' END)"
)


def sql_segment(c: str, max_len: int = 30, min_len: int = 5) -> str:
    """The cut and merge folds as ``list_reduce`` over (pieces so far, open piece)."""
    cell = lambda lst: f"list_transform({lst}, lambda q: {{'o': CAST([] AS VARCHAR[]), 'c': q}})"
    zero = "{'o': CAST([] AS VARCHAR[]), 'c': ''}"
    close = lambda r: f"list_transform([{r}], lambda r: CASE WHEN r.c = '' THEN r.o ELSE list_append(r.o, {sql_strip('r.c')}) END)[1]"
    pieces = f"list_filter(list_transform(regexp_extract_all({c}, '[^。？！；…]*[。？！；…]|[^。？！；…]+$'), lambda q: {sql_strip('q')}), lambda q: q <> '')"
    cur = "(a.c || v.c)"
    pos = f"(length(regexp_extract({cur}, '(?s)^(.*)[ ，,]', 0)) - 1)"
    cut = close(
        f"list_reduce({cell(f"string_split({c}, '')")}, lambda a, v: CASE WHEN length({cur}) < {max_len} THEN {{'o': a.o, 'c': {cur}}} "
        f"WHEN {pos} > {max_len * 0.5} THEN {{'o': list_append(a.o, {sql_strip(f'substr({cur}, 1, {pos} + 1)')}), 'c': substr({cur}, {pos} + 2)}} "
        f"ELSE {{'o': list_append(a.o, {sql_strip(cur)}), 'c': ''}} END, {zero})"
    )
    chosen = f"CASE WHEN len({pieces}) <= 1 AND length({c}) > {max_len} THEN {cut} ELSE {pieces} END"
    merged = close(
        f"list_reduce({cell(chosen)}, lambda a, v: CASE WHEN length(a.c) + length(v.c) < {min_len} THEN {{'o': a.o, 'c': a.c || v.c}} "
        f"WHEN a.c = '' THEN {{'o': a.o, 'c': v.c}} ELSE {{'o': list_append(a.o, {sql_strip('a.c')}), 'c': v.c}} END, {zero})"
    )
    return f"list_filter({merged}, lambda q: q <> '')"


def _flat(c: str) -> str:
    return f"trim(regexp_replace(array_to_string({_MARK.format(c)}, ' '), '{x.WS}+', ' ', 'g'), ' ')"


_RULED = sql_rules(_PLAIN_RULES, "text")
_PARA_RULES = (
    [(x.quote(w), "") for w in P.redundant] + [(f"{o}，", o) for o in P.ordinals]
    + [(f"{x.WS}+", " "), (f"，{x.WS}*，", "，"), ("^ +| +$", "")]
)
_PARA = (
    "array_to_string(list_filter(list_transform(string_split(" + sql_strip("text") + ", chr(10)), lambda p: array_to_string("
    "list_transform(list_filter(list_transform(list_filter(string_split(p, '。'), lambda s: " + sql_strip("s") + " <> ''), lambda s: "
    + sql_rules(_PARA_RULES, "s") + "), lambda s: s <> ''), lambda s: s || '。'), ' ')), lambda p: p <> ''), ' ')"
)


def sql_clean(source: str, keys: str, cut: bool = True) -> str:
    """``source`` has the keys and ``text``; gives the keys and the cleaned ``text``."""
    body = f"array_to_string({sql_segment('g')}, ' ')" if cut else "g"
    return f"""SELECT {keys}, CASE WHEN {sql_strip('text')} = '' THEN '' WHEN regexp_matches(text, '^([。？！；，]|{x.WS})+$') THEN '。'
  WHEN regexp_matches(text, '{x.any_of(P.ordinals)}') AND contains(text, chr(10)) THEN {_PARA}
  WHEN f <> '' AND NOT regexp_matches(f, '[。？！；…]$') THEN f || '。' ELSE f END AS text
FROM (SELECT {keys}, text, {_flat('h')} AS f FROM (SELECT {keys}, text, {body} AS h FROM (SELECT {keys}, text, {_RULED} AS g FROM {source})))"""


@query("T06_clean_text_uncut", sql_clean("documents", "doc_id", False))
def clean_text_uncut(spark, d):
    return docs(spark, d).select("doc_id", x.clean_text("text", P, cut_sentences=False).alias("text"))


@query("T06_clean_text", sql_clean("documents", "doc_id"))
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", x.clean_text("text", P).alias("text"))


@query("T07_clean_paragraphs", f"SELECT doc_id, {_PARA} AS text FROM documents")
def clean_paragraphs(spark, d):
    return docs(spark, d).select("doc_id", x.clean_paragraphs(x.strip("text"), P).alias("text"))


@query("T23_redundant_rules", f"SELECT doc_id, {sql_rules(x.redundant_rules(P), 'text')} AS text FROM documents")
def redundant_rules(spark, d):
    return docs(spark, d).select("doc_id", x.apply_rules("text", x.redundant_rules(P)).alias("text"))


@query("T08_segment", f"""SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS piece FROM (
  SELECT doc_id, {sql_segment('g')} AS l FROM (SELECT doc_id, translate(text, '.?!;', '。？！；') AS g FROM documents))""")
def segment(spark, d):
    return exploded(docs(spark, d), x.segment(F.translate("text", ".?!;", "。？！；")), "piece")


@query("T09_restore_marks", f"""
SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS marked FROM (SELECT doc_id, list_transform({PIECES}, lambda r: list_transform([{sql_strip('r')}], lambda s:
  CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '[。？！；…]$') THEN s WHEN regexp_matches(s, '{x.any_of(P.question_words)}')
  THEN s || '？' ELSE s || '。' END)[1]) AS l FROM documents)""")
def restore_marks(spark, d):
    return exploded(docs(spark, d), x.restore_marks(x.sentences("text", P), P), "marked")


_DOUBLED = "replace(replace(text, 'thth', 'th'), 'nana', 'na')"


@query("T10_squash", f"""
WITH c AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS ch FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, ch ORDER BY pos) AS run FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ch, run) AS size, row_number() OVER (PARTITION BY doc_id, ch, run ORDER BY pos) AS k FROM r),
s AS (SELECT doc_id, string_agg(ch, '' ORDER BY pos) AS text FROM n WHERE size < 4 OR k = 1 GROUP BY 1)
SELECT doc_id, {_DOUBLED} AS text FROM s""")
def squash(spark, d):
    return docs(spark, d).select("doc_id", x.squash("text", P).alias("text"))


@query("T11_formatted_lines", f"""SELECT meeting_id, seg_no, speaker || ': ' || text AS line FROM ({sql_clean(f"(SELECT conv_id AS meeting_id, turn AS seg_no, role AS speaker, {sql_strip('text')} AS text FROM conversations)", "meeting_id, seg_no, speaker")})
WHERE text <> ''""")
def formatted_lines(spark, d):
    return seg_ops.formatted_lines(t.segments(spark, d), P)


_TOKENS = [("token", P.token), ("topic", P.topic_token), ("keyword", P.keyword_token)]


@query("T12_tokens", " UNION ALL ".join(
    f"SELECT '{v}' AS variant, w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS w FROM documents) GROUP BY ALL"
    for v, p in _TOKENS))
def tokens(spark, d):
    df = docs(spark, d)
    # all shapes in one pass over the texts
    def named(v):
        return F.transform(x.tokens("text", P, v), lambda w: F.struct(F.lit(v).alias("variant"), w.alias("token")))

    tagged_ = F.flatten(F.array(*[named(v) for v, _ in _TOKENS]))
    return df.select(F.inline(tagged_)).groupBy("variant", "token").agg(F.count(F.lit(1)).alias("n"))


@query("T13_shorten", f"""
SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 60), '，,。；; ') || '...' END AS text
FROM (SELECT doc_id, {sql_strip('text')} AS s FROM documents)""")
def shorten(spark, d):
    return docs(spark, d).select("doc_id", x.shorten("text", 60).alias("text"))


def _hits(words) -> str:
    return " + ".join(f"CAST(contains(text, '{w}') AS BIGINT)" for w in words)


SENTIMENT = f"""SELECT doc_id, p AS positive_count, n AS negative_count, round(s, 2) AS score,
  CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM (
  SELECT doc_id, p, n, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS s FROM (
    SELECT doc_id, {_hits(P.positive)} AS p, {_hits(P.negative)} AS n FROM documents))"""


@query("T14_sentiment", SENTIMENT)
def sentiment(spark, d):
    return docs(spark, d).select("doc_id", x.sentiment("text", P).alias("s")).select("doc_id", "s.*")


@query("T15_sentiment_scores", f"""
SELECT doc_id, round(a, 3) AS positive, round(greatest(0, 1 - greatest(a, b)), 3) AS neutral, round(b, 3) AS negative FROM (
  SELECT doc_id, greatest(0, least(1, 0.5 + score / 2)) AS a, greatest(0, least(1, 0.5 - score / 2)) AS b FROM ({SENTIMENT}))""")
def sentiment_scores(spark, d):
    scored = docs(spark, d).select("doc_id", x.sentiment("text", P)["score"].alias("score"))
    return scored.select("doc_id", x.sentiment_scores("score").alias("s")).select("doc_id", "s.*")


@query("T16_sentiment_band", f"""
SELECT doc_id, CASE WHEN score < -0.3 THEN 'negative' WHEN score <= 0.3 THEN 'neutral' ELSE 'positive' END AS band FROM ({SENTIMENT})""")
def sentiment_band(spark, d):
    return docs(spark, d).select("doc_id", x.sentiment_band(x.sentiment("text", P)["score"]).alias("band"))


_DUE = (
    DuePhrase("1-URGENT", "weekday", "FRI"), DuePhrase("2-HIGH", "weekday_after", "WED"),
    DuePhrase("3-MEDIUM", "weekday_after", "MON"), DuePhrase("5-LOW", "month_end"),
)
_NEXT = "o_orderdate + to_days(CAST((({wd} - isodow(o_orderdate) + 6) % 7) + 1 + {extra} AS INTEGER))"


@query("T17_task_phrases", f"""
SELECT o_orderkey AS id, {STAMP.format(f'''CASE o_orderpriority WHEN '1-URGENT' THEN {_NEXT.format(wd=5, extra=0)}
  WHEN '2-HIGH' THEN {_NEXT.format(wd=3, extra=7)} WHEN '3-MEDIUM' THEN {_NEXT.format(wd=1, extra=7)}
  WHEN '5-LOW' THEN CAST(last_day(o_orderdate) AS TIMESTAMP) END''')} AS due FROM orders""")
def task_phrases(spark, d):
    due = dates.parse_task_phrase("o_orderpriority", F.col("o_orderdate"), _DUE)
    return t.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(due, FMT).alias("due"))


_PHRASES = (
    "本周五", "下周一", "下周三", "下周日", "下个月", "月底", "月末", "Q1", "Q2", "Q3", "Q4", "第一季度", "第四季度", "今天", "明天", "昨天",
    "后天", "本周三",
)
_PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + f"][o_orderkey % {len(_PHRASES)} + 1]"


def _week(target: int) -> str:
    return f"day + CAST(CASE WHEN (7 - wd + {target}) % 7 = 0 THEN 7 ELSE (7 - wd + {target}) % 7 END AS INTEGER)"


def _quarter(month: int) -> str:
    start = f"make_date(year(day), {month}, 1)"
    return f"CASE WHEN {start} < day THEN make_date(year(day) + 1, {month}, 1) ELSE {start} END"


@query("T18_entity_phrases", f"""
SELECT id, phrase, {STAMP.format(f'''CAST(CASE phrase WHEN '本周五' THEN day + CAST(CASE WHEN 4 - wd <= 0 THEN 11 - wd ELSE 4 - wd END AS INTEGER)
  WHEN '下周一' THEN day + CAST(7 - wd AS INTEGER) WHEN '下周三' THEN {_week(2)} WHEN '下周日' THEN {_week(6)}
  WHEN '下个月' THEN last_day(day) + 1 WHEN '月底' THEN last_day(day) WHEN '月末' THEN last_day(day)
  WHEN 'Q1' THEN {_quarter(1)} WHEN 'Q2' THEN {_quarter(4)} WHEN 'Q3' THEN {_quarter(7)} WHEN 'Q4' THEN {_quarter(10)}
  WHEN '第一季度' THEN {_quarter(1)} WHEN '第四季度' THEN {_quarter(10)}
  WHEN '今天' THEN day WHEN '明天' THEN day + 1 WHEN '昨天' THEN day - 1 END AS TIMESTAMP)''')} AS due
FROM (SELECT o_orderkey AS id, {_PHRASE_SQL} AS phrase, CAST(o_orderdate AS DATE) AS day, isodow(o_orderdate) - 1 AS wd FROM orders)""")
def entity_phrases(spark, d):
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("o_orderkey") % len(_PHRASES) + 1).cast("int"))
    rows = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), phrase.alias("phrase"), "o_orderdate")
    due = dates.parse_entity_phrase("phrase", F.col("o_orderdate"))
    return rows.select("id", "phrase", F.date_format(due, FMT).alias("due"))


_ABS = """CASE o_orderkey % 4 WHEN 0 THEN 'due ' || year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日'
  WHEN 1 THEN 'by ' || year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)
  WHEN 2 THEN month(o_orderdate) || '月' || day(o_orderdate) || '日' ELSE year(o_orderdate) || '-' || (month(o_orderdate) + 10) || '-31' END"""


@query("T19_parse_absolute", f"""
SELECT id, phrase, {STAMP.format('''CAST(CASE id % 4 WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN TRY_CAST('1998-' || strftime(day, '%m-%d') AS DATE)
  ELSE TRY_CAST(strftime(day, '%Y-') || (month(day) + 10) || '-31' AS DATE) END AS TIMESTAMP)''')} AS due
FROM (SELECT o_orderkey AS id, {_ABS} AS phrase, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def parse_absolute(spark, d):
    day = F.col("o_orderdate")
    y, m, dd = (f(day).cast("string") for f in (F.year, F.month, F.day))
    k = F.col("o_orderkey") % 4
    phrase = (
        F.when(k == 0, F.concat(F.lit("due "), y, F.lit("年"), m, F.lit("月"), dd, F.lit("日")))
        .when(k == 1, F.concat(F.lit("by "), F.concat_ws("-", y, m, dd))).when(k == 2, F.concat(m, F.lit("月"), dd, F.lit("日")))
        .otherwise(F.concat(y, F.lit("-"), (F.month(day) + 10).cast("string"), F.lit("-31")))
    )
    rows = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), phrase.alias("phrase"))
    return rows.select("id", "phrase", F.date_format(dates.parse_absolute("phrase", t.AS_OF), FMT).alias("due"))


_TYPE = """CASE WHEN contains(phrase, '年') OR contains(phrase, '-') THEN 'date'
  WHEN regexp_matches(phrase, '今天|明天|昨天|本周|下周|下个月|月底|月末') THEN 'relative'
  WHEN regexp_matches(phrase, '^Q|季度') THEN 'quarter' ELSE 'relative' END"""


@query("T20_T21_date_type_confidence", f"""
SELECT phrase, kind, round((7 + CASE WHEN length(phrase) >= 2 THEN 1 ELSE 0 END
  + CASE kind WHEN 'date' THEN 2 WHEN 'relative' THEN -1 ELSE 0 END) / 10, 1) AS confidence, count(*) AS n
FROM (SELECT phrase, {_TYPE} AS kind FROM (SELECT {_PHRASE_SQL} AS phrase FROM orders UNION ALL SELECT {_ABS} FROM orders)) GROUP BY ALL""")
def date_type_confidence(spark, d):
    rows = entity_phrases(spark, d).select("phrase").unionAll(parse_absolute(spark, d).select("phrase"))
    typed = rows.withColumn("kind", dates.date_type("phrase"))
    return typed.groupBy("phrase", "kind", F.round(dates.entity_confidence("phrase", "kind"), 1).alias("confidence")).agg(
        F.count(F.lit(1)).alias("n")
    )


_AGE = "(epoch(TIMESTAMP '1998-08-01 00:00:00') - epoch(created_at))"


@query("T22_time_labels", with_(TASKS) + f"""
SELECT id, CASE WHEN s = 0 THEN '0秒' ELSE trim(CASE WHEN s // 3600 > 0 THEN (s // 3600) || '小时 ' ELSE '' END ||
    CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || '分钟 ' ELSE '' END || CASE WHEN s % 60 > 0 THEN (s % 60) || '秒' ELSE '' END) END AS took,
  CASE WHEN age > 31536000 THEN (age // 31536000) || ' 年前' WHEN age > 2592000 THEN (age // 2592000) || ' 月前' WHEN age > 86400 THEN (age // 86400) || ' 天前'
    WHEN age > 3600 THEN (age // 3600) || ' 小时前' WHEN age > 60 THEN (age // 60) || ' 分钟前' ELSE '刚刚' END AS ago,
  CAST(floor((epoch_us(due_date) - epoch_us(TIMESTAMP '1998-08-01 00:00:00')) / 86400000000.0) AS BIGINT) AS days_left
FROM (SELECT *, CAST(floor(amount + 0.5) AS BIGINT) AS s, CAST(floor({_AGE}) AS BIGINT) AS age FROM tasks)""")
def time_labels(spark, d):
    return t.tasks(spark, d).select(
        "id", x.format_duration("amount").alias("took"), dates.time_ago("created_at", t.AS_OF).alias("ago"),
        dates.days_until("due_date", t.AS_OF).alias("days_left"),
    )


@query("T24_safe_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def safe_name(spark, d):
    return t.load(spark, d, "pages").select("page_id", x.safe_name("url").alias("name"))


@query("P08_low_value", f"SELECT conv_id, turn, {LOW} AS low FROM conversations")
def low_value(spark, d):
    return t.load(spark, d, "conversations").select("conv_id", "turn", x.is_low_value("text", P).alias("low"))


@query("P08_low_value_tokens", f"SELECT text, {LOW} AS low, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS text FROM documents) GROUP BY text")
def low_value_tokens(spark, d):
    words = docs(spark, d).select(F.explode(F.split("text", " ")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return words.select("text", x.is_low_value("text", P).alias("low"), "n")


@query("P09_informative", f"""
SELECT conv_id, turn, {sql_strip('text')} <> '' AND ({MARKED} OR len(regexp_extract_all({sql_strip('text')}, '{P.script_char}')) >= 12) AS informative
FROM conversations""")
def informative(spark, d):
    return t.load(spark, d, "conversations").select("conv_id", "turn", x.is_informative("text", P).alias("informative"))


VALID_TOPIC = (
    "(length({c}) BETWEEN 2 AND 24 AND NOT contains(upper({c}), 'SPEAKER_') AND NOT regexp_matches({c}, '[0-9]{{4,}}') "
    f"AND lower({{c}}) NOT IN {sql_list(P.topic_stop_lower)} AND {{c}} NOT IN {sql_list(P.topic_stop)} "
    f"AND NOT regexp_matches({{c}}, '^[A-Za-z]{{{{1,3}}}}$') AND NOT regexp_matches({{c}}, '{REPEATED}|{REPEATED.upper()}'))"
)
_T = f"trim({sql_strip('w')}, ' ，,.:;:!?！？。；【】[]()（）\"')"


@query("P10_valid_topic", f"""
SELECT w AS name, {VALID_TOPIC.format(c=_T)} AS valid, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w""")
def valid_topic(spark, d):
    words = docs(spark, d).select(F.explode(F.split("text", " ")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return words.select("name", x.is_valid_topic("name", P).alias("valid"), "n")


@query("P13_speaker_index", """
SELECT c_custkey AS id, CAST(nullif(regexp_extract(c_name || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END, '([0-9]+)$', 1), '') AS BIGINT) AS idx FROM customer""")
def speaker_index(spark, d):
    name = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(""))
    return t.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), x.speaker_index(name).alias("idx"))


__all__ = ["NORM", "SENTIMENT", "VALID_TOPIC", "docs"]
