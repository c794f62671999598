"""Live sessions, utterances, status logs, metric windows and workflow joins.

Built from Spark's own stateful operators (windows, session windows, deduplication,
stream-stream joins): state is one aggregate per key and window, never a list of rows.
Time columns are ``timestamp``.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from colloquy.operators.changes import TERMINAL
from colloquy.plans.hot import SLICE, TARGET_ROWS, carry, earlier_slices, in_slice, slice_keys


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A sample table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def work_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints for a query's state and output."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="stream-")
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/{uuid.uuid4()}"


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is there, then stop; the result is read back from the sink's files."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    out = f"{folder}/out"
    query = writer.format("parquet").option("path", out).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _watermark(df: DataFrame, at: str, delay: str) -> DataFrame:
    return df.withWatermark(at, delay) if df.isStreaming else df


# --- sessions ---------------------------------------------------------------------------------------

def _parts(messages: DataFrame) -> DataFrame:
    """Messages as (session_id, at, seq, language, size, ends): one of the last three says what a message is."""
    m = F.col("message")
    head = len("audio_base64:")
    return messages.select(
        "session_id", F.col("ts").alias("at"), "seq", F.when(m.startswith("start:"), F.trim(F.substring(m, 7, 2147483647))).alias("language"),
        F.when(m.startswith("audio_base64:"), F.length(m) - head).cast("bigint").alias("size"), m.startswith("end:").alias("ends"),
    )


RECORDING = "session_id long, language string, started_at timestamp, ended_at timestamp, chunks long, encoded_size long"


def assemble_sessions(messages: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """One row per recording: a key may have any number of them, one after the other.

    ``messages(session_id, ts, seq, message)`` in the order of (ts, seq): ``start:<language>``
    opens, or changes the language of what is open; ``audio_base64:...`` appends; the first
    ``end:`` closes. Messages while nothing is open are left out, and so is a recording that
    never ends. Sessions above ``target`` messages are cut into slices.
    """
    key = ["session_id"]
    timed = _parts(messages).withColumn("_at", F.unix_micros("at"))
    rows, cut = slice_keys(timed, key, ["_at", "seq"], target)
    here = in_slice(key, "_at", "seq")
    past = here.rowsBetween(-9223372036854775808, -1)
    state = F.when(F.col("ends"), False).when(F.col("language").isNotNull(), True)
    local = rows.withColumn("_closed", F.coalesce(F.sum(F.col("ends").cast("bigint")).over(past), F.lit(0))).withColumn("_is", F.last(state, True).over(past))

    def earlier(ends: DataFrame, over) -> DataFrame:
        before = earlier_slices(over)
        return ends.select(*key, SLICE, F.sum("_ends").over(before).alias("_done"), F.last("_state", True).over(before).alias("_was"))

    edges = [F.sum(F.col("ends").cast("bigint")).alias("_ends"), F.max_by(state, F.when(state.isNotNull(), F.struct("_at", "seq"))).alias("_state")]
    linked = carry(local, key, edges, earlier, cut)
    part = F.col("_closed") + F.coalesce("_done", F.lit(0))
    open_ = F.coalesce("_is", "_was", F.lit(False))
    chunk = F.col("size").isNotNull() & open_
    starts = F.col("language").isNotNull()
    grouped = linked.withColumn("_part", part).groupBy(*key, "_part").agg(
        F.max_by("language", F.when(starts, F.struct("_at", "seq"))).alias("language"), F.min(F.when(starts, F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("ends"), F.col("at"))).alias("ended_at"), F.count_if(chunk).alias("chunks"), F.sum(F.when(chunk, F.col("size")).otherwise(0)).alias("encoded_size"),
    )
    done = grouped.filter(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull())
    return done.select("session_id", F.nullif(F.col("language"), F.lit("")).alias("language"), "started_at", "ended_at", "chunks", "encoded_size")


def stream_sessions(messages: DataFrame, timeout: str = "24 hours", delay: str = "10 minutes") -> DataFrame:
    """The same recordings from a stream, each as its end comes.

    State is five counters per session, dropped when a recording ends or the watermark has
    passed its last message by ``timeout``. Messages of a batch are put in order; those of
    a later batch come after them.
    """
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(list(batches)).sort_values(["at", "seq"])
        now = list(state.get) if state.exists else [None, None, 0, 0]
        done = []
        for at, language, size, ends in zip(got["at"], got["language"], got["size"], got["ends"]):
            if isinstance(language, str):
                now = [language, now[1] or at.value // 1000, now[2], now[3]]
            elif now[1] is None:
                continue
            elif ends:
                done.append((key[0], now[0] or None, pd.Timestamp(now[1], unit="us"), at, now[2], now[3]))
                now = [None, None, 0, 0]
            elif not pd.isna(size):
                now = [now[0], now[1], now[2] + 1, now[3] + int(size)]
        if now[1] is None:
            state.remove()
        else:
            state.update(tuple(now))
            state.setTimeoutTimestamp(max(int(got["at"].max().value // 10**6), state.getCurrentWatermarkMs() + 1) + wait)
        if done:
            yield pd.DataFrame(done, columns=["session_id", "language", "started_at", "ended_at", "chunks", "encoded_size"])

    parts = _parts(messages.withWatermark("ts", delay))
    return parts.groupBy("session_id").applyInPandasWithState(
        update, RECORDING, "language string, started long, chunks long, size long", "append", GroupStateTimeout.EventTimeTimeout
    )


def unknown_commands(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("message").rlike("^(start|audio_base64|end):")).select(
        "session_id", "ts", F.lit("error:unknown_command").alias("reply")
    )


def stream_utterances(seg: DataFrame, gap: str = "6 seconds", delay: str = "1 minute") -> DataFrame:
    """Live talk of one speaker without a pause longer than ``gap``; ``seg`` has a ``ts``."""
    return _watermark(seg, "ts", delay).groupBy("meeting_id", "speaker", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("characters")
    ).select("meeting_id", "speaker", F.col("w.start").alias("started_at"), F.col("w.end").alias("closes_at"), "turns", "characters")


def utterance_sessions(seg: DataFrame, gap_seconds: float = 6.0, target: int = TARGET_ROWS) -> DataFrame:
    """The same sessions on a bounded frame, cut into slices where one speaker has too many rows."""
    key = ["meeting_id", "speaker"]
    timed = seg.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    rows, cut = slice_keys(timed, key, "_at", target)
    here, gap = in_slice(key, "_at"), int(gap_seconds * 1e6)
    before = F.lag("_at").over(here)
    local = rows.withColumn("_new", F.when(before.isNotNull(), F.col("_at") - before > gap))

    def link(ends: DataFrame, over) -> DataFrame:
        fresh = F.coalesce(F.col("_lo") - F.lag("_hi").over(over) > gap, F.lit(True))
        ends = ends.withColumn("_fresh", fresh)
        ends = ends.withColumn("_open", F.coalesce("_cut", F.when(F.col("_fresh"), F.col("_lo"))))
        return ends.select(*key, SLICE, "_fresh", F.last("_open", True).over(earlier_slices(over)).alias("_since"))

    edges = [F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.max(F.when(F.col("_new"), F.col("_at"))).alias("_cut")]
    linked = carry(local, key, edges, link, cut)
    opened = F.when(F.coalesce("_new", "_fresh", F.lit(True)), F.col("_at"))
    running = here.rowsBetween(-9223372036854775808, 0)
    begin = F.coalesce(F.last(opened, True).over(running), F.col("_since"))
    return linked.withColumn("_begin", begin).groupBy(*key, "_begin").agg(
        F.max("_at").alias("_end"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("characters")
    ).select(*key, F.timestamp_micros("_begin").alias("started_at"), F.timestamp_micros(F.col("_end") + gap).alias("closes_at"), "turns", "characters")


# --- status log --------------------------------------------------------------------------------------------

STATES = "task_key long, status string, payload string, last_at timestamp, events long, alive boolean"


def stream_latest(log: DataFrame) -> DataFrame:
    """Changed states of a stream: per key the last status and payload that are not null, the last time and a count.

    An aggregate in ``update`` mode: rows of a key are combined in every task before the
    shuffle, and its state is one row, kept for ever; see ``stream_states`` for lifetimes.
    """
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return log.groupBy("task_key").agg(last("status"), last("payload"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("events"), F.lit(True).alias("alive"))


#: rows of many keys held by a task before they go on
HELD_KEYS = 1 << 16
PARTIAL = "task_key long, status string, status_at long, status_id long, payload string, payload_at long, payload_id long, last_at timestamp, events long"


def combine_states(log: DataFrame) -> DataFrame:
    """Rows of a key combined within their task (``PARTIAL``): a busy key sends one row per task and batch.

    A stream allows no aggregate before another stateful step, so this works on the
    task's rows as they come and holds at most ``HELD_KEYS`` keys.
    """
    def latest(rows: pd.DataFrame, field: str) -> pd.DataFrame:
        kept = rows[rows[field].notna()].drop_duplicates("task_key", keep="last")
        return kept[["task_key", field, f"{field}_at", f"{field}_id"]]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.groupby("task_key", as_index=False, dropna=False).agg(last_at=("last_at", "max"), events=("events", "sum"))
        for field in ("status", "payload"):
            out = out.merge(latest(rows.sort_values([f"{field}_at", f"{field}_id"]), field), "left", "task_key")
        return out

    def run(batches):
        held = None
        for rows in batches:
            held = merge(rows if held is None else pd.concat([held, rows]))
            if len(held) > HELD_KEYS:
                yield held[columns]
                held = None
        if held is not None and len(held):
            yield held[columns]

    columns = [c.split(" ")[0] for c in PARTIAL.split(", ")]
    at = F.unix_micros("ts")
    rows = log.select(
        F.col("task_key").cast("long").alias("task_key"), "status", at.alias("status_at"), F.col("event_id").cast("long").alias("status_id"),
        "payload", at.alias("payload_at"), F.col("event_id").cast("long").alias("payload_id"), F.col("ts").alias("last_at"), F.lit(1).cast("long").alias("events"),
    )
    return rows.mapInPandas(run, PARTIAL)


class StateTable(StatefulProcessor):
    """One value per key and one timer: the end of its lifetime, later with each event."""

    FIELDS = "status string, status_at long, status_id long, payload string, payload_at long, payload_id long, last long, events long"

    def __init__(self, task_hours: int, result_hours: int):
        self.task_hours, self.result_hours = task_hours, result_hours

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.FIELDS)

    def _until(self, now: tuple) -> int:
        return now[6] // 1000 + 3_600_000 * (self.result_hours if now[0] in TERMINAL else self.task_hours)

    def _row(self, key, now: tuple, alive: bool) -> Row:
        at = datetime.fromtimestamp(now[6] // 10**6, timezone.utc).replace(microsecond=now[6] % 10**6)
        return Row(task_key=key[0], status=now[0], payload=now[3], last_at=at, events=now[7], alive=alive)

    def handleInputRows(self, key, rows, timerValues):
        now = tuple(self.value.get()) if self.value.exists() else (None, None, None, None, None, None, 0, 0)
        # partial rows come one by one and in any order; the latest by (time, event) wins
        for row in rows:
            status, payload = now[:3], now[3:6]
            if row.status is not None and (status[0] is None or (row.status_at, row.status_id) > status[1:]):
                status = (row.status, int(row.status_at), int(row.status_id))
            if row.payload is not None and (payload[0] is None or (row.payload_at, row.payload_id) > payload[1:]):
                payload = (row.payload, int(row.payload_at), int(row.payload_id))
            seen = row.last_at.replace(tzinfo=row.last_at.tzinfo or timezone.utc) - EPOCH
            now = (*status, *payload, max(now[6], seen // timedelta(microseconds=1)), now[7] + row.events)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.value.update(now)
        self.handle.registerTimer(max(self._until(now), timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, now, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.value.exists():
            now = tuple(self.value.get())
            self.value.clear()
            yield self._row(key, now, False)

    def close(self) -> None:
        pass


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def stream_states(log: DataFrame, task_hours: int = 48, result_hours: int = 24, delay: str = "10 minutes") -> DataFrame:
    """``stream_latest`` with lifetimes: a key's state is dropped when the watermark has passed its last event by its lifetime.

    Ended tasks live shorter than open ones. Dropping comes out as a row with ``alive``
    false; a key that comes again later starts anew. For ``update`` mode and a session
    with the RocksDB state store, see ``run_states``.
    """
    rows = combine_states(log).withWatermark("last_at", delay)
    return rows.groupBy("task_key").transformWithState(StateTable(task_hours, result_hours), STATES, "Update", "EventTime")


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_states(states: DataFrame) -> DataFrame:
    """Process what is there in ``update`` mode and read the last row of each key.

    A batch writes its changed rows only, under its own number, so a repeated batch
    replaces itself; keys are merged when the table is read.
    """
    spark, folder = states.sparkSession, work_folder(states.sparkSession)
    out, before = f"{folder}/out", spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        writer = states.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("update")
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    finally:
        # a query keeps the settings it was started with
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    query.awaitTermination()
    rows = spark.read.schema(f"{STATES}, batch long").parquet(out)
    columns = [f.name for f in states.schema]
    return rows.groupBy("task_key").agg(F.max_by(F.struct(*columns[1:]), "batch").alias("_s")).select("task_key", "_s.*")


def replay(log: DataFrame, at: str = "ts", batches: int = 4) -> DataFrame:
    """A stored log as a stream that brings it in the order of ``at``, a file and batch for each share of its rows.

    The shares are cut at quantiles and written one after the other, since a file source
    goes by the age of its files.
    """
    spark, folder = log.sparkSession, f"{work_folder(log.sparkSession)}/log"
    micros = F.unix_micros(at)
    cuts = log.agg(F.percentile_approx(micros, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    share = F.lit(0)
    for cut in cuts:
        share = share + F.when(micros > cut, 1).otherwise(0)
    for k in range(batches):
        log.filter(share == k).coalesce(1).write.parquet(f"{folder}/share={k}")
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/share=*").drop("share")


def expire(states: DataFrame, as_of, task_hours: int = 48, result_hours: int = 24) -> DataFrame:
    """States still alive: results live shorter than open tasks."""
    hours = F.when(F.col("status").isin(*TERMINAL), result_hours).otherwise(task_hours)
    until = F.unix_micros(F.col("last_at").cast("timestamp")) + hours.cast("bigint") * F.lit(3_600_000_000)
    now = F.unix_micros(F.lit(as_of).cast("timestamp")) if isinstance(as_of, str) else F.unix_micros(as_of)
    return states.filter(until > now)


def terminal_events(log: DataFrame) -> DataFrame:
    """Each key's terminal states once, for whoever waits for them.

    On a stream the state is the distinct (key, status) pairs: a state that came again
    later has been told already, however long ago.
    """
    last = log.filter(F.col("status").isin(*TERMINAL)).select("task_key", "status")
    return last.dropDuplicates(["task_key", "status"])


def metric_windows(metrics: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Count, average and maximum of ``value`` per window and key."""
    at = _watermark(metrics, "ts", delay)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return at.groupBy(w.alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("average"), F.max("value").alias("peak")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "average", "peak")


def _stages(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both stages in one frame: (task_key, at, stage 0 or 1, event_id)."""
    one = lambda df, stage: df.select("task_key", F.col("ts").alias("at"), F.lit(stage).alias("stage"), "event_id")
    return one(first, 0).unionAll(one(second, 1))


def stage_join(first: DataFrame, second: DataFrame, within_seconds: int = 3600, target: int = TARGET_ROWS) -> DataFrame:
    """Events of a second stage with the latest first-stage event of their key, at most so long before.

    One partner per second event: the last first event is carried along in time order, so
    no pair is built that is not in the result. Busy keys are cut into slices.
    """
    timed = _stages(first, second).withColumn("_at", F.unix_micros("at"))
    rows, cut = slice_keys(timed, ["task_key"], ["_at", "stage", "event_id"], target)
    here = in_slice(["task_key"], "_at", "stage", "event_id")
    opened = F.when(F.col("stage") == 0, F.struct("event_id", "at"))
    local = rows.withColumn("_first", F.last(opened, True).over(here.rowsBetween(-9223372036854775808, -1)))

    def earlier(ends: DataFrame, over) -> DataFrame:
        return ends.select("task_key", SLICE, F.last("_last", True).over(earlier_slices(over)).alias("_carried"))

    edges = [F.max_by(opened, F.when(F.col("stage") == 0, F.struct("_at", "event_id"))).alias("_last")]
    linked = carry(local, ["task_key"], edges, earlier, cut).withColumn("_first", F.coalesce("_first", "_carried"))
    near = F.col("at") <= F.col("_first.at") + F.expr(f"INTERVAL {int(within_seconds)} SECONDS")
    return linked.filter((F.col("stage") == 1) & near).select(
        "task_key", F.col("_first.event_id").alias("first_id"), F.col("event_id").alias("second_id"), F.col("_first.at").alias("first_at"), F.col("at").alias("second_at")
    )


def stream_stage_join(first: DataFrame, second: DataFrame, within_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """The same pairs from two streams; state is a key's latest first event, dropped after the bound."""
    names = ["task_key", "first_id", "second_id", "first_at", "second_at"]
    bound = within_seconds * 1_000_000

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(list(batches)).sort_values(["at", "stage", "event_id"])
        open_id, open_at = state.get if state.exists else (None, 0)
        found = []
        for at, stage, event in zip(got["at"], got["stage"], got["event_id"]):
            now = at.value // 1000
            if stage == 0:
                open_id, open_at = int(event), now
            elif open_id is not None and now - open_at <= bound:
                found.append((key[0], open_id, event, pd.Timestamp(open_at, unit="us"), at))
        if open_id is not None:
            state.update((open_id, open_at))
            state.setTimeoutTimestamp(max((open_at + bound) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=names)

    rows = _stages(first, second).withWatermark("at", delay)
    out = "task_key long, first_id long, second_id long, first_at timestamp, second_at timestamp"
    return rows.groupBy("task_key").applyInPandasWithState(update, out, "first_id long, first_at long", "append", GroupStateTimeout.EventTimeTimeout)
