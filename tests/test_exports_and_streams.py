import shutil

import pytest
from pyspark.sql import functions as F

from colloquy.catalog.live import log, messages
from colloquy.operators import topics as tp
from colloquy.packs import PROSE
from colloquy.sources import exports, tables as t
from colloquy.streaming import live


def test_write_transcripts(spark, small, tmp_path):
    seg = t.segments(spark, small)
    exports.write_transcripts(seg, str(tmp_path / "j"), "json", 4)
    assert spark.read.json(str(tmp_path / "j")).count() == seg.count()
    exports.write_transcripts(seg.withColumn("text", F.lit("hi")), str(tmp_path / "t"), "txt", 4)
    assert spark.read.text(str(tmp_path / "t")).filter(F.col("value").startswith("[")).count() == seg.count()
    with pytest.raises(ValueError):
        exports.write_transcripts(seg, str(tmp_path / "x"), "srt")


def test_declared_schema(spark, tmp_path):
    t.align_schema(spark.range(3), "id bigint, title string").write.parquet(str(tmp_path / "meetings.parquet"))
    meetings = t.load(spark, str(tmp_path), "meetings")
    assert "key_topics" in meetings.columns and meetings.count() == 3


def test_stored_replies(spark):
    rows = [('{"a": 1}', '{"a": 1}'), ('x ```json\n[1, 2]\n``` y', "[1, 2]"), ("{'a': 1, }", None), ("say {\"a\": {\"b\": 2}} ok", '{"a": {"b": 2}}'), ("none", None), (None, None)]
    df = spark.createDataFrame(rows, "c string, want string")
    got = [r.j for r in df.select(exports.extract_json("c").alias("j")).collect()]
    assert got[:2] == [rows[0][1], rows[1][1]] and got[2].replace(" ", "") == '{"a":1}' and got[3:] == [rows[3][1], None, None]
    task = '{"action_items": [{"description": "张三负责前端开发", "assignee": "张三", "due_date": "本周五", "priority": "URGENT", "confidence": 7}, {"description": "短"}]}'
    item = exports.validate_tasks(spark.createDataFrame([(1, task)], "k long, response string"), ["k"], "2024-03-20 09:30:00").collect()
    assert [(r.description, r.assignee, str(r.due_date), r.priority, r.confidence) for r in item] == [("张三负责前端开发", "张三", "2024-03-22 09:30:00", "medium", 1.0)]
    bad = exports.validate_summary(spark.createDataFrame([("nothing",)], "response string")).first()
    assert bad.summary == "" and bad.key_topics == [] and bad.sentiment_overall == 0.0 and bad.summary_type == "abstractive"


def test_export_parts_are_whole(spark, small):
    m, k = t.meetings(spark, small), t.tasks(spark, small)
    notes = t.comments(spark, small).join(k.select(F.col("id").alias("task_id"), "meeting_id"), "task_id")
    docs = exports.export_meetings(m, t.segments(spark, small), k, notes, part_rows=3, target=4)
    assert docs.agg(F.max(F.size("comments"))).first()[0] == 3
    assert docs.select(F.explode("comments")).count() == notes.count() and docs.select(F.explode("tasks")).count() == k.count()


def test_models(spark, small):
    docs = t.corpus(spark, small)
    lda = tp.lda_topics(docs, 3, 200, PROSE)
    assert lda.count() == 15 and lda.filter("weight <= 0 or keyword is null").count() == 0
    clusters = tp.cluster_documents(docs, 4, pack=PROSE)
    assert clusters.count() == docs.count() and clusters.select("cluster").distinct().count() == 4
    assert tp.cluster_documents(docs.limit(1), 4, pack=PROSE).first().cluster == 0


def split_events(spark, small, folder):
    """The event log cut by time into files that arrive one after the other."""
    ev = spark.read.parquet(f"{small}/events.parquet").orderBy("ts").toPandas()
    for i in range(4):
        part = ev.iloc[i * len(ev) // 4:(i + 1) * len(ev) // 4]
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        (src,) = (p for p in (folder / f"tmp{i}").iterdir() if p.suffix == ".parquet")
        shutil.copy(src, folder / f"events-{i}.parquet")
    shutil.copy(f"{small}/events.parquet", folder / "schema.parquet")


def test_streams_over_many_batches(spark, small, tmp_path):
    split_events(spark, small, tmp_path)
    schema = spark.read.parquet(str(tmp_path / "events-0.parquet")).schema
    whole = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))

    def arriving():
        raw = spark.readStream.schema(schema).option("pathGlobFilter", "events-*.parquet").option("maxFilesPerTrigger", 1)
        return raw.parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))

    rows = lambda df: {tuple(map(str, r)) for r in df.collect()}
    windows = rows(live.run_available(live.metric_windows(arriving().drop("value").withColumn("value", F.col("event_id")))))
    assert windows and windows <= rows(live.metric_windows(whole.withColumn("value", F.col("event_id"))))
    # recordings go on over batches; the stream gives those of the bounded form
    sessions = rows(live.run_available(live.stream_sessions(messages(arriving()), "9000 days")))
    assert sessions and sessions == rows(live.assemble_sessions(messages(whole)))
    assert sessions == rows(live.assemble_sessions(messages(whole), target=5))
    # states: merged fields over batches, and what has outlived its time is gone
    def shown(df):
        return rows(df.select("task_key", "status", "payload", "last_at", "events"))

    holes = lambda ev: log(ev).withColumn("payload", F.when(F.col("event_id") % 3 > 0, F.col("payload")))
    at = F.struct("ts", "event_id")
    bounded = holes(whole).groupBy("task_key").agg(
        F.max_by("status", at).alias("status"), F.max_by("payload", F.when(F.col("payload").isNotNull(), at)).alias("payload"),
        F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("events"),
    )
    assert shown(live.run_states(live.stream_latest(holes(arriving())))) == shown(bounded)
    assert shown(live.run_states(live.stream_states(holes(arriving()), 10**6, 10**6)).filter("alive")) == shown(bounded)
    # exactly the keys whose time is over are told as dropped
    short = {str(r.task_key): r.alive for r in live.run_states(live.stream_states(holes(arriving()), 6, 2)).collect()}
    end = whole.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    alive = {r[0] for r in rows(live.expire(bounded, str(end), 6, 2).select("task_key"))}
    assert {k for k, there in short.items() if there} == alive and set(short) == {r[0] for r in rows(bounded)}
    assert not all(short.values())
    # a terminal state once per key, one partner per event
    assert rows(live.run_available(live.terminal_events(log(arriving())))) == rows(live.terminal_events(log(whole)))
    stages = lambda ev: [log(ev.filter(F.col("event_type") == k)) for k in ("signup", "purchase")]
    pairs = rows(live.run_available(live.stream_stage_join(*stages(arriving()), 10**7)))
    assert pairs == rows(live.stage_join(*stages(whole), 10**7)) == rows(live.stage_join(*stages(whole), 10**7, target=3))
    assert len({p[2] for p in pairs}) == len(pairs) > 0


def test_recordings(spark):
    """Several recordings of one key, messages outside of them, a second start and a missing end."""
    said = ["audio_base64:zz", "end:", "start: zh ", "audio_base64:abc", "start:en", "audio_base64:de", "end:", "audio_base64:x", "end:", "start:", "end:", "start:fr", "audio_base64:q"]
    rows = [(1, k, f"2024-01-01 00:00:{k:02d}", m) for k, m in enumerate(said)] + [(2, 0, "2024-01-01 00:00:00", "start:a"), (3, 0, "2024-01-01 00:00:00", "end:")]
    df = spark.createDataFrame(rows, "session_id long, seq long, at string, message string").withColumn("ts", F.col("at").cast("timestamp"))
    for target in (2, 1000):
        got = [(r.session_id, r.language, r.started_at.second, r.ended_at.second, r.chunks, r.encoded_size) for r in live.assemble_sessions(df, target).orderBy("started_at").collect()]
        assert got == [(1, "en", 2, 6, 2, 5), (1, None, 9, 10, 0, 0)]


def test_sessions_in_slices(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    talk = ev.select(F.lit(1).alias("meeting_id"), F.lit("a").alias("speaker"), "ts", F.col("props").alias("text"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(live.utterance_sessions(talk, 900.0, target=7)) == rows(live.utterance_sessions(talk, 900.0))


def test_enhance(spark):
    from colloquy.operators.changes import enhance

    rows = [(1, 0, "A", "你好", 0.0, 1.0, .9), (1, 1, "A", "你好", 1.2, 2.0, .9), (1, 2, "A", "在吗", 2.5, 3.0, .7), (1, 3, "B", "好。", 9.0, 9.5, .5)]
    seg = spark.createDataFrame(rows, "meeting_id long, seg_no long, speaker string, text string, start_time double, end_time double, confidence double")
    assert [r.text for r in enhance(seg, gap=2.0).orderBy("start_time").collect()] == ["你好 在吗？", "好。"]
    assert enhance(seg, merge=False, duplicates=False, punctuation=False).count() == 4


def test_update_keeps_completion(spark):
    from colloquy.operators.changes import apply_task_updates

    tasks = spark.createDataFrame([(1, "pending", None), (2, "completed", "2024-01-01 00:00:00"), (3, "completed", "2024-01-02 00:00:00")], "id long, status string, c string")
    tasks = tasks.select("id", "status", F.col("c").cast("timestamp_ntz").alias("completed_at"))
    updates = spark.createDataFrame([(1, 1, "blocked"), (1, 2, "completed"), (2, 1, None), (3, 1, "pending")], "id long, seq long, status string")
    got = {r.id: (r.status, str(r.completed_at)) for r in apply_task_updates(tasks, updates, "2024-02-01 00:00:00").collect()}
    assert got == {1: ("completed", "2024-02-01 00:00:00"), 2: ("completed", "2024-01-01 00:00:00"), 3: ("pending", "None")}


def test_busy_keys_are_combined_before_the_shuffle(spark):
    data = [(k % 3 if k % 2 else 7, k, None if k % 5 else f"s{k}", None if k % 4 else f"p{k}", k) for k in range(4000)] + [(None, 1, "x", None, 5)]
    frame = spark.createDataFrame(data, "task_key long, event_id long, status string, payload string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    parts = live.combine_states(frame.repartition(4)).collect()
    assert len(parts) <= 4 * 5 and sum(r.events for r in parts) == len(data)
    for key in (0, 1, 2, 7):
        mine = [r for r in data if r[0] == key]
        got = [r for r in parts if r.task_key == key]
        assert max((r.status_at, r.status) for r in got if r.status)[1] == max((r[4], r[2]) for r in mine if r[2])[1]
        assert max((r.payload_at, r.payload) for r in got if r.payload)[1] == max((r[4], r[3]) for r in mine if r[3])[1] if any(r[3] for r in mine) else True
        assert sum(r.events for r in got) == len(mine)


def test_replay_brings_a_log_in_order(spark, small):
    ev = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = []
    query = live.replay(ev, batches=3).writeStream.foreachBatch(lambda df, n: seen.append(df.agg(F.count("*"), F.min("ts"), F.max("ts")).first())).trigger(availableNow=True)
    query.option("checkpointLocation", live.work_folder(spark)).start().awaitTermination()
    seen = [r for r in seen if r[0]]
    assert len(seen) == 3 and sum(r[0] for r in seen) == ev.count() and all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
