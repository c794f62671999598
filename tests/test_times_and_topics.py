"""Overlaps on grids of several widths, ISO times, and topics level by level."""

import random

from pyspark.sql import functions as F

from colloquy.functions.dates import iso_time
from colloquy.operators import segments as ops, tasks, topics as tp
from colloquy.packs import PROSE
from colloquy.plans import insights

TIMED = "meeting_id long, seg_no long, speaker string, text string, start_time double, end_time double"


def best_turns(said, turns):
    out = {}
    for m, n, who, _, s, e in said:
        ways = [(min(e, f) - max(s, b), -k, name) for p, k, name, _, b, f in turns if p == m and None not in (s, e, b, f) and min(e, f) > max(s, b)]
        best = max(ways, default=None)
        out[m, n] = (best[2], round(best[0], 6)) if best else (who, None)
    return out


def test_overlaps_of_all_lengths(spark):
    rnd = random.Random(3)

    def rows(names, count):
        out = []
        for n in range(count):
            start = rnd.choice([rnd.uniform(0, 120), rnd.uniform(0, 1e5), float(rnd.randrange(0, 4000, 60))])
            length = rnd.choice([0.0, 0.3, 60.0, 61.0, 3600.0, 7680.0, rnd.uniform(0, 3e4), 31_536_000.0, -5.0])
            out.append((n % 4, n, rnd.choice(names), "x", start, start + length))
        return out

    said, turns = rows("AB", 300), rows("PQR", 200)
    said += [(0, 900, "A", "x", None, 5.0), (9, 901, "A", "x", 1.0, 2.0)]
    turns += [(0, 800, "P", "x", None, None), (7, 801, "Q", "x", 3.0, 9.0)]
    found = ops.assign_speaker(spark.createDataFrame(said, TIMED), spark.createDataFrame(turns, TIMED)).collect()
    assert len(found) == len(said) + 1
    got = {(r.meeting_id, r.seg_no): (r.speaker, None if r.overlap is None else round(r.overlap, 6)) for r in found}
    assert got.pop((7, 801)) == ("Q", None)
    assert got == best_turns(said, turns)


def test_long_turns_touch_few_cells(spark):
    """A turn of a thousand years beside a crowded minute is put into a few cells, not one per minute."""
    turns = spark.createDataFrame([(1, 0, "P", "x", 0.0, 3.2e10), (1, 1, "Q", "x", 30.0, 31.0)], TIMED)
    said = spark.range(20_000).select(F.lit(1).cast("long").alias("meeting_id"), F.col("id").alias("seg_no"), F.lit("A").alias("speaker"), F.lit("x").alias("text"), (F.col("id") / 400).alias("start_time"))
    said = said.withColumn("end_time", F.col("start_time") + 0.5)
    out = ops.assign_speaker(said, turns)
    assert {r.speaker: r["count"] for r in out.groupBy("speaker").count().collect()} == {"P": 20_000}


def test_iso_times(spark):
    cases = {
        "2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04": "2024-01-02 03:04:00", "2024-01-02T03": "2024-01-02 03:00:00", "2024-01-02 03:04:05,5": "2024-01-02 03:04:05.5",
        "2024-01-02T03:04:05.1234567": "2024-01-02 03:04:05.123456", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+0530": "2024-01-01 21:34:05",
        "2024-01-02T23:04:05-01": "2024-01-03 00:04:05", "2024-02-30": None, "2024-01-02T24:00": None, "2024-01-02T03:60": None, "2024-01-02T03:04+24:00": None, "2024-01-02T03:04+01:60": None,
        "2024-1-2": None, "20240102": None, "": None, "now": None, None: None, " 2024-01-02": None, "2024-01-02T": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", iso_time("t").alias("v")).collect()
    expected = {k: v and (v if "." in v else v + ".0") for k, v in cases.items()}
    assert {r.t: r.v and f"{r.v:%Y-%m-%d %H:%M:%S}." + (f"{r.v.microsecond:06d}".rstrip("0") or "0") for r in rows} == expected


def test_levels_see_only_the_keys_left(spark):
    keys = spark.range(6).withColumnRenamed("id", "k")
    seen = []

    def level(known):
        def rows(left):
            seen.append(sorted(r.k for r in left.collect()))
            data = [(k, i, name, ["budget", "Budget", "x"]) for k, names in known.items() for i, name in enumerate(names)]
            return spark.createDataFrame(data, "k long, pos int, name string, keywords array<string>").join(left, "k", "left_semi")
        return rows

    levels = [(level({0: ["budget", "Budget", "1"], 1: ["?"]}), True), (level({0: ["other"], 1: ["hiring"]}), True), (level({2: ["b", "a"]}), False)]
    got = {r.k: (r.source, r.topics and [(t.rank, t.name, t.keywords) for t in r.topics]) for r in tp.cascade_topics(keys, ["k"], levels, 5, PROSE).collect()}
    assert seen == [[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [2, 3, 4, 5]]
    assert got[0] == (0, [(1, "budget", ["budget"])]) and got[1] == (1, [(1, "hiring", ["budget"])])
    assert [t[1] for t in got[2][1]] == ["b", "a"] and got[3] == got[4] == got[5] == (None, None)
    done = tp.cascade_topics(keys.limit(0), ["k"], levels, 5, PROSE)
    assert done.count() == 0


def test_keywords_by_rank_with_tokens_as_fallback(spark):
    rows = [(1, 0, "A", "alpha beta alpha gamma alpha", 0.0, 1.0), (1, 1, "A", "lonely", 1.0, 2.0), (1, 2, "B", " ", 2.0, 3.0)]
    seg = spark.createDataFrame(rows, TIMED)
    got = {r.seg_no: r.keywords for r in insights.process_transcript(seg, "2024-03-20 09:30:00", PROSE, with_entities=False, with_sentiment=False).collect()}
    assert [k.token for k in got[0]][0] == "alpha" and len(got[0]) == 3 and got[0][0].n is None
    assert [(k.token, k.n, k.weight) for k in got[1]] == [("lonely", 1, 1.0)] and got[2] is None


def test_pages_behind_rows_are_the_whole_list(spark):
    rnd = random.Random(8)
    data = [(k, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"])) for k in range(60)]
    df = spark.createDataFrame(data, "id long, n int, s string").repartition(3)
    order = [("n", True), ("s", False), ("id", True)]
    listed = [r.id for r in df.orderBy(F.col("n").desc(), F.col("s").asc(), F.col("id").desc()).collect()]
    found, last = [], None
    while rows := tasks.page_after(df, order, last, 13).collect():
        found += [r.id for r in rows]
        last = rows[-1].asDict()
    assert found == listed
