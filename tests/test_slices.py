"""Ordered operators give the same rows however finely a large key is cut."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import segments as ops
from colloquy.packs import PROSE
from colloquy.plans.hot import number_rows
from colloquy.sources import tables as t


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    left, right = ([tuple(map(repr, r)) for r in x.select(*cols).collect()] for x in (a, b))
    assert left and sorted(left) == sorted(right)


def rounded(df):
    return df.withColumn("confidence", F.round("confidence", 6))


@pytest.fixture(scope="module")
def random_segments(spark):
    rnd, rows = random.Random(5), []
    for m in range(20):
        for n in range(60):
            start = rnd.uniform(0, 90)
            rows.append((m, n, rnd.choice("AB"), rnd.choice(["x", "yes", " "]) + str(n % 9), start,
                         start + rnd.choice([0.2, 1.0, 9.0]), rnd.random()))
    return spark.createDataFrame(rows, SEGMENTS), rows


SEGMENTS = "meeting_id long, seg_no long, speaker string, text string, start_time double, end_time double, confidence double"


@pytest.mark.parametrize("target", [2, 1 << 17])
def test_merge_rows(spark, target):
    """Worked-out rows: gap at its border, a turn inside another, a blank one between, another speaker, blank meetings."""
    rows = [
        (1, 0, "A", "a", 0.0, 1.0, 0.8), (1, 1, "A", "b ", 2.0, 3.0, 0.4), (1, 2, "A", "c", 4.1, 5.0, 0.6), (1, 3, "B", "d", 4.5, 4.6, 0.5),
        (1, 4, "B", " ", 5.0, 5.1, 0.5), (1, 5, "A", "e", 5.2, 9.0, 0.2), (1, 6, "A", "f", 6.0, 7.0, 0.4), (1, 7, "A", "g", 9.9, 10.0, 0.5),
        (2, 0, "A", " ", 0.0, 1.0, 0.1), (2, 1, "B", "", 1.0, 2.0, 0.2),
    ]
    got = ops.merge_adjacent(spark.createDataFrame(rows, SEGMENTS), 1.0, target).orderBy("meeting_id", "start_time").collect()
    assert [(r.meeting_id, r.seg_no, r.speaker, r.text, r.start_time, r.end_time, round(r.confidence, 6), r.parts) for r in got] == [
        (1, 0, "A", "a b", 0.0, 3.0, 0.6, 2), (1, 2, "A", "c", 4.1, 5.0, 0.6, 1), (1, 3, "B", "d", 4.5, 4.6, 0.5, 1),
        (1, 5, "A", "e f g", 5.2, 10.0, 0.4, 3), (2, 0, "A", " ", 0.0, 1.0, 0.1, 1), (2, 1, "B", "", 1.0, 2.0, 0.2, 1),
    ]


@pytest.mark.parametrize("target", [7, 1 << 17])
def test_merge_properties(random_segments, target):
    df, rows = random_segments
    merged = ops.merge_adjacent(df, 1.0, target).orderBy("meeting_id", "start_time", "seg_no").collect()
    spoken = [r for r in rows if r[3].strip()]
    # every spoken segment is in one result row, and its words and reach are kept
    assert sum(r.parts for r in merged) == len(spoken)
    for m in range(20):
        mine, out = [r for r in spoken if r[0] == m], [r for r in merged if r.meeting_id == m]
        assert sorted("".join(r[3] for r in mine).replace(" ", "")) == sorted("".join(r.text for r in out).replace(" ", ""))
        starts = sorted((r[4], r[1]) for r in mine)
        for k, r in enumerate(out):
            # a row holds the segments from its start to the next row's start, all of one speaker
            end = (out[k + 1].start_time, out[k + 1].seg_no) if k + 1 < len(out) else (float("inf"), 0)
            held = [s for s in mine if (r.start_time, r.seg_no) <= (s[4], s[1]) < end]
            assert len(held) == r.parts and {s[2] for s in held} == {r.speaker} and max(s[5] for s in held) == r.end_time
            assert (r.start_time, r.seg_no) in starts
            # the next row of the same speaker begins beyond the gap
            if k + 1 < len(out) and out[k + 1].speaker == r.speaker:
                assert out[k + 1].start_time > r.end_time + 1.0


def test_one_hot_meeting(random_segments):
    df, _ = random_segments
    one = df.withColumn("meeting_id", F.lit(1)).withColumn("seg_no", F.row_number().over(
        __import__("pyspark").sql.Window.orderBy("start_time", "seg_no")).cast("long"))
    same(rounded(ops.merge_adjacent(one, 1.0, 16)), rounded(ops.merge_adjacent(one, 1.0)))
    same(ops.utterance_blocks(one, 0.05, 40, PROSE, target=16), ops.utterance_blocks(one, 0.05, 40, PROSE))
    same(ops.utterance_blocks(one, 1e9, 40, PROSE, target=5), ops.utterance_blocks(one, 1e9, 40, PROSE))


def test_views_and_plans(spark, small):
    seg, cut = t.segments(spark, small), t.segments(spark, small, target=2)
    same(seg, cut)
    same(ops.to_srt(seg), ops.to_srt(seg, target=2))
    same(ops.utterance_blocks(seg, pack=PROSE), ops.utterance_blocks(seg, pack=PROSE, target=2))
    raw = seg.withColumn("speaker", F.lit(None).cast("string"))
    same(t.normalize_segments(raw), t.normalize_segments(raw, target=3))
    ev = t.timed_events(spark, small)
    same(rounded(ops.merge_adjacent(ev, 3600.0)), rounded(ops.merge_adjacent(ev, 3600.0, target=9)))
    series = ev.select(F.col("meeting_id").alias("recording_id"), F.col("start_time").alias("ts"),
                       ((F.col("end_time") - F.col("start_time")) / 60).alias("value"))
    same(ops.quiet_regions(series, 86400.0, 27.0, 0.0), ops.quiet_regions(series, 86400.0, 27.0, 0.0, target=3))


def test_number_rows(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * F.col("id")).alias("o"))
    got = number_rows(df, ["k"], ["o"], target=10).orderBy("o").collect()
    assert [r.idx for r in got] == list(range(1000))


def test_dense_stretches_are_cut_again(spark):
    """Most rows crowd into a sliver of the range: no slice may keep them all."""
    from colloquy.plans.hot import SLICE, slice_keys

    rows = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") < 10, F.col("id") * 1e6).otherwise(5e5 + F.col("id") / 1e3).alias("o"))
    cut, any_cut = slice_keys(rows, ["k"], "o", 100)
    sizes = [r["count"] for r in cut.groupBy(SLICE).count().collect()]
    assert any_cut and sum(sizes) == 4000 and max(sizes) <= 200
    got = number_rows(rows, ["k"], ["o"], target=100).orderBy("o").collect()
    assert [r.idx for r in got] == list(range(4000))
    assert slice_keys(rows, ["k"], "o", 5000)[1] is False


@pytest.mark.parametrize("kind", ["one time", "one time and nulls", "dense", "few values"])
def test_rows_of_one_order_value_are_cut_by_the_next_column(spark, kind):
    from pyspark.sql import Window
    from colloquy.plans.hot import SLICE, slice_keys

    at = {
        "one time": F.lit(5.0), "one time and nulls": F.when(F.col("id") % 3 > 0, 5.0),
        "dense": F.when(F.col("id") % 100 == 0, F.col("id") * 1000.0).otherwise(F.col("id") / 1e6), "few values": (F.col("id") % 4).cast("double"),
    }[kind]
    df = spark.range(6000).withColumn("at", at).withColumn("key", F.when(F.col("id") % 50 == 0, 1).otherwise(0))
    rows, cut = slice_keys(df, ["key"], ["at", "id"], target=200)
    rows = rows.cache()
    sizes = {(r.key, r[SLICE]): r["count"] for r in rows.groupBy("key", SLICE).count().collect()}
    assert cut and max(sizes.values()) <= 400 and sum(sizes.values()) == 6000 and sizes[1, 0] == 120
    # slices follow the whole order
    over = Window.partitionBy("key").orderBy("at", "id")
    assert rows.withColumn("before", F.lag(SLICE).over(over)).filter(F.col("before") > F.col(SLICE)).isEmpty()
    same(number_rows(df, ["key"], ["at", "id"], target=200), number_rows(df, ["key"], ["at", "id"]))


def test_merging_many_segments_of_one_start(spark):
    rows = [(1, n, "AB"[n // 7 % 2], f"w{n}", float(n // 400), float(n // 400) + 0.5, 0.5) for n in range(1200)]
    df = spark.createDataFrame(rows, SEGMENTS)
    same(rounded(ops.merge_adjacent(df, 1.0, target=50)), rounded(ops.merge_adjacent(df, 1.0)))
