"""Steps whose work is split by what they make of a table: the rows of brute force, and as many tasks as are needed."""

import math
import random
from collections import Counter

from colloquy.catalog import QUERIES, load_all, writing
from colloquy.functions.text import has_any
from colloquy.operators import segments, summary, topics
from colloquy.packs import PROSE
from colloquy.plans import hot
from colloquy.sources import exports

load_all()


def partitions(df):
    return df.rdd.getNumPartitions()


def test_long_texts_get_partitions_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(hot, "TASK_TEXT", 100)
    df = spark.createDataFrame([(k, "some words here. " * 10) for k in range(100)], "doc_id long, text string")
    assert partitions(hot.place_texts(df, "doc_id")) == 171
    assert summary.extractive_summary(df, pack=PROSE).count() == 100


def test_rows_that_grow_are_spread_over_the_tasks(spark):
    lengths = spark.createDataFrame([(1, 100.0), (2, 45.0)], "id long, duration double").coalesce(1)
    replies = spark.createDataFrame([(1, '{"action_items": []}')], "k long, response string").coalesce(1)
    for rows in (segments.fixed_segments(lengths, 30, "client"), segments.fixed_segments(lengths, 30, "virtual"),
                 exports.validate_tasks(replies, ["k"], "2024-03-20 09:30:00", pack=PROSE)):
        assert partitions(rows) >= spark.sparkContext.defaultParallelism
    assert segments.fixed_segments(lengths, 30, "virtual").count() == 6


def test_ranges_number_rows_of_null_keys_and_values(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, 1.0, 2.0]), k) for k in range(500)]
    got = hot.number_rows(spark.createDataFrame(rows, "k long, at double, id long"), ["k"], ["at", "id"], target=20).collect()
    first = lambda v: (v is not None, v or 0)
    for key in (None, 1, 2):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (first(r[1]), r[2]))
        assert [r.id for r in sorted((r for r in got if r.k == key), key=lambda r: r.idx)] == [r[2] for r in mine]
        assert sorted(r.idx for r in got if r.k == key) == list(range(len(mine)))


def test_names_behind_the_first_rows_count(spark):
    late = ["a"] * 40 + ["Alpha", "beta", "ALPHA", "gamma"]
    full = [f"Name{c}" for c in "abcdefg"] + ["x"] * 40
    rows = [(k, p, w, [w]) for k, words in ((None, late), (1, late), (2, full), (3, ["a"] * 50)) for p, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, name string, keywords array<string>")
    got = {}
    for r in topics.sanitize_topics(df, ["doc_id"], 5, PROSE).orderBy("rank").collect():
        got.setdefault(r.doc_id, []).append(r.name)
    assert got == {None: ["Alpha", "beta", "gamma"], 1: ["Alpha", "beta", "gamma"], 2: full[:5]}


def test_keywords_of_few_candidates_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(topics, "HEAD_TOKENS", 5)
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(60)]
    texts = [(None if k == 7 else k % 50, " ".join(rnd.choices(words, weights=[1 / (n + 1) for n in range(60)], k=rnd.randint(0, 80)))) for k in range(60)]
    counts = {}
    for k, x in texts:
        counts.setdefault(k, Counter()).update(x.split())
    spread = Counter(w for c in counts.values() for w in c)
    expected = set()
    for k, c in counts.items():
        best = sorted(((-round(n * math.log((len(counts) + 1) / (spread[w] + 1)), 9), w) for w, n in c.items()))[:4]
        expected |= {(k, rank + 1, w) for rank, (_, w) in enumerate(best)}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = topics.tfidf_keywords(df, k=4, pack=PROSE)
    assert {(r.doc_id, r.rank, r.token) for r in found.collect()} == expected
    # only texts' words that may be among the best are joined
    assert "_kth" in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_one_file_are_taken_apart_by_all_tasks(spark, tmp_path):
    rows = [(k, None if k == 3 else f"To plan the thing {k}, that is for the others. Then not the end.", "en", "s", 60) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    corpus = writing.placed_docs(spark, str(tmp_path))
    assert partitions(writing.docs(spark, str(tmp_path))) == 1 and partitions(corpus) >= spark.sparkContext.defaultParallelism
    assert corpus.select("doc_id", "text").exceptAll(df.select("doc_id", "text")).isEmpty() and corpus.count() == 200
    for name in ("X06_refine_tasks", "X07_tasks_with_entities", "X11_structured_summary", "X12_rule_topics"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan


def test_literal_words_are_found_without_a_regex(spark):
    texts = ["a.b", "axb", "", None, "(c", "né"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, text string")
    found = df.select("k", has_any("text", (".b", "(c", "é")).alias("v"), has_any("text", ()).alias("none"))
    assert {r.k: (r.v, r.none) for r in found.collect()} == {0: (True, False), 1: (False, False), 2: (False, False), 3: (None, False), 4: (True, False), 5: (True, False)}
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_keywords_place_texts_once(spark):
    df = spark.createDataFrame([(k, f"alpha beta{'x' * (k % 7)} gamma{'y' * (k % 5)} alpha") for k in range(60)], "doc_id long, text string")
    found = topics.tfidf_keywords(df, k=2, pack=PROSE)
    assert found.count() > 60
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    placed = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
    words = [x for x in plan.splitlines() if "hashpartitioning(token" in x and "ENSURE_REQUIREMENTS" in x]
    # one shuffle of texts and one of the words' counts; all other uses read them again
    assert len([x for x in placed if "ReusedExchange" not in x]) == 1 and len(placed) >= 2
    assert len([x for x in words if "ReusedExchange" not in x and "token" in x]) <= 2 and any("ReusedExchange" in x for x in words)


def test_topics_without_keywords_are_named_by_their_tokens(spark):
    texts = [(1, "tree tree house"), (1, None), (2, "Lake lake boat, the the the"), (2, "boat lake"), (3, "a, 12"), (None, "river river")]
    keywords = [(1, "house", 2.0), (1, "tree", 1.0), (None, "river", 3.0)]
    df = spark.createDataFrame(texts, "topic long, text string")
    kw = spark.createDataFrame(keywords, "topic long, keyword string, score double")
    found = {r.topic: r.name for r in topics.name_topics(kw, df, pack=PROSE).collect()}
    assert found == {1: "house", 2: "lake", 3: "主题_3", None: None}
    # where each topic has a keyword, no text is taken apart
    all_named = topics.name_topics(kw, df.filter("topic = 1"), pack=PROSE)
    assert [tuple(r) for r in all_named.collect()] == [(1, "house")]
    assert "regexp_extract_all" not in all_named._jdf.queryExecution().optimizedPlan().toString()
