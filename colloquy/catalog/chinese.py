"""Queries with the default pack: Chinese sentences around columns of the tables, against literal results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.catalog.registry import query
from colloquy.functions import text as x
from colloquy.operators import extract as ex
from colloquy.packs import ZH
from colloquy.sources import tables as t

NOW = "2024-03-20 09:30:00"
NAMES = ("张三", "李四", "王五", "赵六")
PARTS = ("前端开发", "后端接口", "数据报表", "测试环境", "项目文档")


def _pick(options: tuple[str, ...], at: Column) -> Column:
    return F.array(*[F.lit(o) for o in options])[(at % len(options)).cast("int")]


def _sql_pick(options: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(o) for o in options)}][CAST({at} % {len(options)} AS INT) + 1]"


_NAME, _PART = _sql_pick(NAMES, "doc_id"), _sql_pick(PARTS, "doc_id // 4")


def _said(spark, d, *forms: Column):
    """One sentence per document: the form that its number picks."""
    rows = t.load(spark, d, "documents").select("doc_id", "source").withColumn("name", _pick(NAMES, F.col("doc_id")))
    rows = rows.withColumn("part", _pick(PARTS, F.floor(F.col("doc_id") / 4)))
    kind = F.col("doc_id") % len(forms)
    text = F.coalesce(*[F.when(kind == n, form) for n, form in enumerate(forms)])
    return rows.select("doc_id", "source", text.alias("text"))


def _of(*pieces: str) -> Column:
    """A sentence of literals and the columns name, part and source."""
    return F.concat(*[F.col(p) if p in ("name", "part", "source") else F.lit(p) for p in pieces])


@query("X03_tasks_zh", f"""
SELECT doc_id, 0 AS pattern, {_NAME} || '负责' || {_PART} AS description, {_NAME} AS assignee, CAST(NULL AS VARCHAR) AS due_text, 'low' AS priority, 0.75 AS confidence FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 5, '测试团队要负责所有' || {_PART} || '（截止月底）', NULL, '月底', 'low', 0.85 FROM documents WHERE doc_id % 3 = 1""")
def tasks_zh(spark, d):
    rows = _said(spark, d, _of("name", "负责", "part", "，需要在本周五前完成。"), _of("测试团队要在月底前完成所有", "part", "。"), _of("今天天气很好，大家都来了。"))
    found = ex.rule_tasks(rows, ["doc_id"], NOW, ZH, 0.6)
    return found.select("doc_id", F.col("pos.pattern").alias("pattern"), "description", "assignee", "due_text", "priority", F.round("confidence", 2).alias("confidence"))


@query("T06_clean_zh", f"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '今天' || {_PART} || '很好。' WHEN 1 THEN '说我们要看' || {_PART} || '。' WHEN 2 THEN {_NAME} || '来了吗？'
  WHEN 3 THEN '' ELSE {_NAME} || '说完成了。' END AS cleaned FROM documents""")
def clean_zh(spark, d):
    rows = _said(
        spark, d, _of("呃，今天", "part", "很好。。嗯"), _of("就是说我们要看", "part"), _of("name", "来了吗"), _of("  "), _of("name", "说完成了。"),
    )
    return rows.select("doc_id", x.clean_text("text").alias("cleaned"))


@query("T08_segment_zh", f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_PART} || '很好。|' || {_NAME} || '也来了！' WHEN 1 THEN '好。是。|' || {_NAME} || '完成了' || {_PART}
  ELSE repeat('甲', 20) || '，|' || repeat('乙', 20) END AS pieces FROM documents""")
def segment_zh(spark, d):
    rows = _said(spark, d, _of("part", "很好。", "name", "也来了！"), _of("好。是。", "name", "完成了", "part"), _of("甲" * 20, "，", "乙" * 20))
    return rows.select("doc_id", F.array_join(x.segment("text"), "|").alias("pieces"))


@query("T14_sentiment_zh", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'positive' END AS mood,
  CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS good, CAST(CASE doc_id % 4 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS bad FROM documents""")
def sentiment_zh(spark, d):
    rows = _said(spark, d, _of("part", "进展非常顺利，大家都很满意"), _of("part", "遇到了严重的问题，进度严重滞后"), _of("name", "看了", "part"), _of("name", "非常好，超出预期"))
    return rows.select("doc_id", x.sentiment("text").alias("s")).select(
        "doc_id", F.col("s.label").alias("mood"), F.col("s.positive_count").cast("bigint").alias("good"), F.col("s.negative_count").cast("bigint").alias("bad")
    )


@query("X07_times_zh", """
SELECT doc_id, unnest(CASE doc_id % 2 WHEN 0 THEN ['明天', '下周三', 'Q3'] ELSE ['月底'] END) AS said, unnest(CASE doc_id % 2 WHEN 0 THEN [0, 5, 11] ELSE [2] END) AS at,
  unnest(CASE doc_id % 2 WHEN 0 THEN ['relative', 'relative', 'quarter'] ELSE ['relative'] END) AS kind FROM documents""")
def times_zh(spark, d):
    rows = _said(spark, d, _of("明天开会，下周三交付，Q3上线", "part"), _of("name", "月底提交", "part"))
    found = rows.select("doc_id", F.explode(ex.time_expressions(F.col("text"), ZH)).alias("m"))
    return found.select("doc_id", F.col("m.text").alias("said"), F.col("m.start").alias("at"), F.col("m.kind").alias("kind"))


@query("X08_organizations_zh", "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN '北京分公司与研发部门' ELSE '' END AS found FROM documents")
def organizations_zh(spark, d):
    rows = _said(spark, d, _of("北京分公司与研发部门开会看", "part"), _of("name", "看", "part"))
    return rows.select("doc_id", F.array_join(ex.organizations(F.col("text"), ZH), "|").alias("found"))


@query("A10_predicates_zh", """
SELECT doc_id, doc_id % 4 < 2 AS low_value, doc_id % 4 = 2 AS informative FROM documents""")
def predicates_zh(spark, d):
    rows = _said(spark, d, _of("嗯"), _of("好的。"), _of("这个方案要给", "name", "看"), _of("朋友们你们好"))
    return rows.select("doc_id", x.is_low_value("text").alias("low_value"), x.is_informative("text").alias("informative"))
