"""Timed transcript segments: merging, blocks, plans of pieces, speaker statistics.

Input rows are ``(meeting_id, seg_no, speaker, text, start_time, end_time, confidence)``;
times are seconds. Ordered operators work on slices of large meetings (plans.hot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.text import WS, clean_text, clock, has_any, is_low_value, squeeze, strip
from colloquy.packs import ZH, RulePack
from colloquy.plans.hot import SLICE, TARGET_ROWS, carry, earlier_slices, in_slice, number_rows, slice_keys, spread

KEY = ["meeting_id"]
RUNNING = (Window.unboundedPreceding, Window.currentRow)


def _duration() -> Column:
    return F.col("end_time") - F.col("start_time")


# --- merging ------------------------------------------------------------------------------

def merge_adjacent(seg: DataFrame, gap: float = 1.0, target: int = TARGET_ROWS) -> DataFrame:
    """Join neighbouring segments of one speaker that start within ``gap`` of the end so far.

    Two levels: runs of the same speaker, and inside a run a break wherever a start lies
    beyond everything before it. The confidence is the fold ``(c + next) / 2``.
    Segments are taken to end no earlier than they start. Blank segments go, but a meeting
    with blank ones only keeps them all as they are.
    """
    # cut by all segments, which needs no look at the texts
    rows, cut = slice_keys(seg, KEY, ["start_time", "seg_no"], target)
    spoken = rows.filter(strip("text") != "")
    order = ["start_time", "seg_no"]
    here = in_slice(KEY, *order)
    changed = ~F.lag("speaker").over(here).eqNullSafe(F.col("speaker")) | (F.row_number().over(here) == 1)
    runs = spoken.withColumn("_new", changed.cast("int")).withColumn("_run", F.sum("_new").over(here.rowsBetween(*RUNNING)))
    in_run = Window.partitionBy(*KEY, SLICE, "_run").orderBy(*order)
    reach = runs.withColumn("_reach", F.max("end_time").over(in_run.rowsBetween(Window.unboundedPreceding, -1)))
    at = F.struct(*order)

    def open_run(ends: DataFrame, over) -> DataFrame:
        """Speaker and furthest end of the run that is open when a slice begins."""
        joined = F.lag("_last").over(over).eqNullSafe(F.col("_first"))
        ends = ends.withColumn("_restart", ((F.col("_runs") > 1) | ~joined).cast("int"))
        ends = ends.withColumn("_chain", F.sum("_restart").over(over.rowsBetween(*RUNNING)))
        chain = Window.partitionBy(*KEY, "_chain").orderBy(SLICE).rowsBetween(*RUNNING)
        ends = ends.withColumn("_far", F.max(F.col("_tail._end")).over(chain))
        return ends.select(
            *KEY, SLICE, F.lag("_last").over(over).alias("_open"), F.lag("_far").over(over).alias("_far")
        )

    tail = F.max(F.struct("_run", F.greatest("_reach", "end_time").alias("_end"))).alias("_tail")
    edges = [F.min_by("speaker", at).alias("_first"), F.max_by("speaker", at).alias("_last"), F.max("_run").alias("_runs"), tail]
    linked = carry(reach, KEY, edges, open_run, cut)
    goes_on = (F.col("_run") == 1) & F.col("_open").eqNullSafe(F.col("speaker"))
    far = F.when(goes_on, F.greatest("_reach", "_far")).otherwise(F.col("_reach"))
    starts = F.when(far.isNull() | (F.col("start_time") > far + gap), at)
    marked = linked.withColumn("_start", starts)

    def open_island(ends: DataFrame, over) -> DataFrame:
        return ends.select(*KEY, SLICE, F.last("_latest", True).over(earlier_slices(over)).alias("_since"))

    marked = carry(marked, KEY, [F.max("_start").alias("_latest")], open_island, cut)
    island = F.coalesce(F.last("_start", True).over(here.rowsBetween(*RUNNING)), F.col("_since"))
    # each join trims the text so far, so only leading blanks of later texts stay
    later = lambda x: F.concat(F.lit(" "), F.regexp_replace(x, f"{WS}+$", ""))
    confidence = F.col("confidence") if "confidence" in seg.columns else F.lit(None).cast("double")
    parts = (
        marked.withColumn("_island", island).groupBy(*KEY, SLICE, "_island")
        .agg(
            F.first("speaker").alias("speaker"), F.max("end_time").alias("_end"),
            F.array_sort(F.collect_list(F.struct(*order, "text", confidence.alias("c")))).alias("_rows"),
        )
        .select(
            *KEY, "_island", SLICE, "speaker", "_end",
            F.col("_rows.text")[0].alias("_t0"), F.size("_rows").alias("_n"),
            F.array_join(F.transform(F.slice("_rows.text", 2, F.size("_rows")), later), "").alias("_rest"),
            F.col("_rows.c")[0].alias("_c0"),
            F.aggregate("_rows.c", F.lit(0.0), lambda acc, c: (acc + c) / 2).alias("_fold"),
        )
    )
    piece = F.struct(F.col(SLICE).alias("s"), F.col("_t0").alias("t"), F.col("_rest").alias("r"), F.col("_n").alias("n"), F.col("_c0").alias("c0"), F.col("_fold").alias("f"))
    merged = parts.groupBy(*KEY, "_island").agg(
        F.first("speaker").alias("speaker"), F.max("_end").alias("end_time"), F.sum("_n").alias("parts"),
        F.array_sort(F.collect_list(piece)).alias("_p"),
    )
    # the first confidence weighs as much as the second one, hence the extra share
    fold = F.aggregate(
        "_p", F.col("_p")[0]["c0"], lambda acc, p: acc * F.pow(F.lit(0.5), p["n"]) + p["f"]
    )
    more = F.transform(F.slice("_p", 2, F.size("_p")), lambda p: F.concat(later(p["t"]), p["r"]))
    joined = strip(F.concat(F.col("_p")[0]["t"], F.col("_p")[0]["r"], F.array_join(more, "")))
    text = F.when(F.col("parts") == 1, F.col("_p")[0]["t"]).otherwise(joined)
    silent = seg.groupBy(*KEY).agg(F.max(strip(F.coalesce("text", F.lit(""))) != "").alias("_said")).filter(~F.col("_said")).select(*KEY)
    blank = seg.join(silent, KEY, "left_semi").select(
        *KEY, "seg_no", "speaker", "start_time", "end_time", "text", confidence.alias("confidence"), F.lit(1).cast("bigint").alias("parts")
    )
    return merged.select(
        *KEY, F.col("_island.seg_no").alias("seg_no"), "speaker", F.col("_island.start_time").alias("start_time"),
        "end_time", text.alias("text"), fold.alias("confidence"), "parts",
    ).unionByName(blank)


def utterance_blocks(
    seg: DataFrame, gap: float = 6.0, max_lines: int = 90, pack: RulePack = ZH, max_chars: int = 180,
    raw_lines: int = 20, target: int = TARGET_ROWS,
) -> DataFrame:
    """Readable lines ``[speaker] text`` of a meeting.

    Low-value turns are dropped, neighbouring turns of a speaker joined, informative
    blocks kept when there are any, and lines cut. Only the leading characters a line can
    show are collected, so a block may be of any length.
    """
    turns = seg.withColumn("text", strip(F.coalesce("text", F.lit("")))).withColumn(
        "speaker", F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("SPEAKER_00"))
    )
    valued = turns.filter(~is_low_value("text", pack))
    # cut by all turns, which needs no look at the texts
    rows, cut = slice_keys(turns, KEY, "seg_no", target)
    kept = rows.filter(~is_low_value("text", pack))
    here = in_slice(KEY, "seg_no")
    near = F.col("start_time") - F.lag("end_time").over(here) <= gap
    first = F.row_number().over(here) == 1
    new = F.when(~first, ~(F.lag("speaker").over(here).eqNullSafe(F.col("speaker")) & near))
    local = kept.withColumn("_new", new)

    def link(ends: DataFrame, over) -> DataFrame:
        before = F.lag("_tail").over(over)
        joins = before["speaker"].eqNullSafe(F.col("_head.speaker")) & (F.col("_head.start_time") - before["end_time"] <= gap)
        ends = ends.withColumn("_head_new", ~F.coalesce(joins, F.lit(False)))
        at_end = F.coalesce("_cut", F.when(F.col("_head_new"), F.col("_head.seg_no")))
        ends = ends.withColumn("_at_end", at_end)
        return ends.select(*KEY, SLICE, "_head_new", F.last("_at_end", True).over(earlier_slices(over)).alias("_since"))

    edges = [
        F.min(F.struct("seg_no", "speaker", "start_time")).alias("_head"),
        F.max(F.struct("seg_no", "speaker", "end_time")).alias("_tail"),
        F.max(F.when(F.col("_new"), F.col("seg_no"))).alias("_cut"),
    ]
    linked = carry(local, KEY, edges, link, cut)
    starts = F.coalesce("_new", "_head_new", F.lit(True))
    block = F.coalesce(F.last(F.when(starts, F.col("seg_no")), True).over(here.rowsBetween(*RUNNING)), F.col("_since"))
    part = squeeze("text")
    in_block = Window.partitionBy(*KEY, SLICE, "block").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.btrim("_part", F.lit(" ，,"))
    rows = (
        linked.withColumn("block", block).withColumn("_part", part)
        .withColumn("_before", F.coalesce(F.sum(F.length(shown)).over(in_block), F.lit(0)))
    )
    marked = has_any("text", pack.important) | F.col("text").rlike(pack.important_regex)
    pieces = rows.groupBy(*KEY, "block", SLICE).agg(
        F.first("speaker").alias("speaker"), F.max(marked).alias("_marked"),
        F.sum(F.regexp_count("text", F.lit(pack.script_char))).alias("_script"), F.count(F.lit(1)).alias("_turns"),
        F.min("start_time").alias("start_time"), F.max(F.struct("seg_no", "end_time")).alias("_last"),
        F.array_sort(F.collect_list(F.when(F.col("_before") <= max_chars + 1, F.struct("seg_no", F.col("_part").alias("t"))))).alias("_lead"),
    )
    # each piece has at least three characters and a joiner, so the first ones fill a line
    order = Window.partitionBy(*KEY, "block").orderBy(SLICE)
    lead = F.when(F.row_number().over(order) <= max_chars // 3 + 2, F.struct(F.col(SLICE), F.col("_lead.t").alias("t")))
    blocks = pieces.withColumn("_lead", lead).groupBy(*KEY, "block").agg(
        F.first("speaker").alias("speaker"), F.max("_marked").alias("_marked"), F.sum("_script").alias("_script"),
        F.sum("_turns").alias("turns"), F.min("start_time").alias("start_time"), F.max("_last").alias("_last"),
        F.array_sort(F.collect_list("_lead")).alias("_lead"),
    )
    blocks = blocks.withColumn("informative", F.col("_marked") | (F.col("_script") >= 12))
    by_kind = Window.partitionBy(*KEY, "informative").orderBy("block")
    # the group limit keeps at most max_lines rows of a meeting and kind per task before the shuffle
    top = blocks.withColumn("line_no", F.row_number().over(by_kind)).filter(F.col("line_no") <= max_lines)
    top = top.withColumn("_any", F.max("informative").over(Window.partitionBy(*KEY))).filter(F.col("informative") == F.col("_any"))
    text = F.btrim(squeeze(F.array_join(F.flatten("_lead.t"), pack.block_joiner)), F.lit(" ，,"))
    line = F.when(F.length(text) > max_chars, F.concat(F.rtrim(F.substring(text, 1, max_chars), F.lit(" ，,")), F.lit("..."))).otherwise(text)
    lines = top.select(
        *KEY, F.col("line_no").cast("bigint").alias("line_no"), "speaker", "turns", "start_time",
        F.col("_last.end_time").alias("end_time"), F.format_string("[%s] %s", F.col("speaker"), line).alias("line"),
    )
    # meetings with nothing but low-value turns show their first raw lines
    raw = turns.filter(F.col("text") != "").withColumn("line_no", F.row_number().over(Window.partitionBy(*KEY).orderBy("seg_no")))
    raw = raw.filter(F.col("line_no") <= min(max_lines, raw_lines)).join(valued.select(*KEY).distinct(), KEY, "left_anti")
    return lines.unionByName(raw.select(
        *KEY, F.col("line_no").cast("bigint").alias("line_no"), "speaker", F.lit(1).cast("bigint").alias("turns"),
        "start_time", "end_time", F.format_string("[%s] %s", F.col("speaker"), F.col("text")).alias("line"),
    ))


def stitch_chunks(seg: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-relative times to recording times; order is by (meeting, start)."""
    at = chunks.select("meeting_id", "chunk_id", F.col("start_time").alias("_at"))
    return seg.join(at, ["meeting_id", "chunk_id"]).select(
        "meeting_id", "chunk_id", "seg_no", "speaker", "text",
        (F.col("start_time") + F.col("_at")).alias("start_time"), (F.col("end_time") + F.col("_at")).alias("end_time"),
    )


# --- plans of pieces ---------------------------------------------------------------------------

def chunk_plan(df: DataFrame, length: float, overlap: float, variant: str = "extend", duration: str = "duration") -> DataFrame:
    """Pieces of each recording.

    ``extend``: step = length, pieces reach ``overlap`` beyond it, one piece when it fits.
    ``step``: step = length over the whole recording. ``inside``: step = length - overlap.
    """
    d, step = F.col(duration), length - overlap if variant == "inside" else length
    if variant not in ("extend", "step", "inside"):
        raise ValueError(f"unknown variant {variant}")
    n = F.ceil(d / step)
    if variant in ("extend", "inside"):
        n = F.when(d <= length, F.lit(1)).otherwise(n)
    rows = df.filter(d > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    reach = length if variant == "inside" else length + overlap
    start = F.col("chunk_no") * F.lit(float(step))
    return rows.withColumn("chunk_start", start).withColumn("chunk_end", F.least(d, start + F.lit(float(reach))))


def fixed_segments(df: DataFrame, length: int = 30, variant: str = "client", duration: str = "duration") -> DataFrame:
    """Stand-in segments of fixed length.

    ``client``: one speaker, pieces under a second dropped. ``virtual``: two speakers in
    turn; a recording of at most one length becomes two halves.
    """
    df, d = spread(df), F.col(duration)
    if variant == "client":
        last = F.ceil(F.floor(d) / length) - 1
        starts = F.sequence(F.lit(0).cast("bigint"), last)
        rows = df.filter(d >= 1).withColumn("seg_no", F.explode(starts))
        start = F.col("seg_no") * F.lit(float(length))
        rows = rows.withColumn("start_time", start).withColumn("end_time", F.round(F.least(start + length, d), 2))
        return rows.filter(F.least(start + length, d) - start >= 1.0).withColumn("speaker", F.lit("SPEAKER_00"))
    if variant != "virtual":
        raise ValueError(f"unknown variant {variant}")
    short = d <= length
    n = F.when(short, F.lit(2)).otherwise(F.ceil(d / length))
    rows = df.filter(d > 0).withColumn("seg_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    size = F.when(short, d / 2).otherwise(F.lit(float(length)))
    start = F.col("seg_no") * size
    return rows.withColumn("start_time", start).withColumn("end_time", F.least(start + size, d)).withColumn(
        "speaker", F.format_string("SPEAKER_%02d", F.col("seg_no") % 2)
    )


# --- numeric series ------------------------------------------------------------------------------

def quiet_regions(
    series: DataFrame, frame: float = 0.02, threshold_db: float = -40.0, min_len: float = 0.5, target: int = TARGET_ROWS
) -> DataFrame:
    """Stretches of ``(recording_id, ts, value)`` whose frames lie below a level.

    Frames have 50 % overlap, so a sample belongs to two of them. A stretch that is
    still open after the last frame ends with the series.
    """
    key, hop = ["recording_id"], frame / 2
    slot = F.floor(F.col("ts") / hop).cast("bigint")
    halves = series.groupBy(*key, slot.alias("slot")).agg(
        F.sum(F.col("value") * F.col("value")).alias("_sq"), F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_ts")
    )
    both = halves.select(*key, F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("frame_no"), "_sq", "_n", "_ts")
    ends = halves.groupBy(*key).agg(F.max("_ts").alias("_stop"))
    frames = both.filter(F.col("frame_no") >= 0).groupBy(*key, "frame_no").agg(F.sqrt(F.sum("_sq") / F.sum("_n")).alias("_rms"))
    # only frames that lie wholly inside the series count
    frames = frames.join(ends, key).filter(F.col("frame_no") * hop + frame <= F.col("_stop"))
    quiet = (F.col("_rms") <= 0) | (20 * F.log10("_rms") < threshold_db)
    numbered = number_rows(frames.filter(quiet), key, ["frame_no"], "_rank", target)
    runs = numbered.groupBy(*key, (F.col("frame_no") - F.col("_rank")).alias("_run")).agg(
        F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.first("_stop").alias("_stop")
    )
    open_ = F.col("last_frame") == F.floor((F.col("_stop") - frame) / hop)
    end = F.when(open_, F.col("_stop")).otherwise((F.col("last_frame") + 1) * hop)
    found = runs.withColumn("start_time", F.col("first_frame") * F.lit(hop)).withColumn("end_time", end)
    return found.filter(F.col("end_time") - F.col("start_time") >= min_len).select(*key, "start_time", "end_time")


def normalize_level(series: DataFrame, target_db: float = -20.0, max_gain: float = 10.0, floor_db: float = -60.0) -> DataFrame:
    """One gain per recording towards a loudness, values clipped to [-1, 1]; silence stays."""
    level = series.groupBy("recording_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("_rms"))
    db = 20 * F.log10("_rms")
    gain = F.when((F.col("_rms") > 0) & (db >= floor_db), F.least(F.pow(F.lit(10.0), (F.lit(target_db) - db) / 20), F.lit(max_gain)))
    gains = level.select("recording_id", gain.alias("gain"))
    scaled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") * F.col("gain")))
    out = series.join(gains, "recording_id")
    return out.withColumn("value", F.when(F.col("gain").isNull(), F.col("value")).otherwise(scaled))


# --- speaker statistics ------------------------------------------------------------------------------

def speaker_contribution(seg: DataFrame) -> DataFrame:
    """Share of speaking time in percent; raw seconds when the total is not positive."""
    per = seg.groupBy("meeting_id", "speaker").agg(F.sum(_duration()).alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy("meeting_id"))
    return per.withColumn("contribution", F.when(total > 0, F.col("seconds") / total * 100).otherwise(F.col("seconds")))


def dialogue_units(col) -> Column:
    """CJK characters plus Latin or digit words."""
    return F.regexp_count(col, F.lit("[\\x{4e00}-\\x{9fff}]")) + F.regexp_count(col, F.lit("[A-Za-z0-9]+"))


def speaker_stats(seg: DataFrame) -> DataFrame:
    """Duration, words, units and segments per speaker with the share of the talk."""
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("Unknown"))
    per = seg.groupBy("meeting_id", name.alias("speaker")).agg(
        F.sum(F.greatest(F.lit(0.0), F.coalesce(_duration(), F.lit(0.0)))).alias("duration"),
        F.sum(F.regexp_count(text, F.lit("[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{2028}\\x{2029}\\x{3000}]+"))).alias("word_count"),
        F.sum(dialogue_units(text)).alias("dialogue_units"), F.count(F.lit(1)).alias("segment_count"),
    )
    whole = Window.partitionBy("meeting_id")
    units, secs, count = (F.sum(c).over(whole) for c in ("dialogue_units", "duration", "segment_count"))
    share = (
        F.when(units > 0, F.col("dialogue_units") / units).when(secs > 0, F.col("duration") / secs)
        .otherwise(F.col("segment_count") / count)
    )
    return per.withColumn("percentage", F.round(share * 100, 2))


def speaker_share_band(stats: DataFrame) -> DataFrame:
    p = F.col("percentage")
    return stats.withColumn("band", F.when(p > 60, "dominant").when(p > 30, "active").otherwise("quiet"))


def diarization_stats(seg: DataFrame) -> DataFrame:
    """Count, total and average per speaker; the row with a null speaker is the meeting."""
    return seg.rollup("meeting_id", "speaker").agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum(_duration()).alias("total_duration"),
        F.avg(_duration()).alias("avg_duration"), F.count_distinct("speaker").alias("speakers"),
    ).filter(F.col("meeting_id").isNotNull())


def speaker_summary(seg: DataFrame) -> DataFrame:
    return seg.filter(strip("text") != "").groupBy("meeting_id", "speaker").agg(
        F.count(F.lit(1)).alias("total_segments"), F.sum(_duration()).alias("total_duration"),
        F.sum(F.length("text")).alias("total_text_length"),
    )


def segment_previews(seg: DataFrame, n: int = 100) -> DataFrame:
    """The previews that go with a speaker summary, one row per segment."""
    cut = F.when(F.length("text") > n, F.concat(F.substring("text", 1, n), F.lit("..."))).otherwise(F.col("text"))
    return seg.filter(strip("text") != "").select("meeting_id", "speaker", "seg_no", "start_time", "end_time", cut.alias("preview"))


def segments_per_speaker(seg: DataFrame) -> DataFrame:
    return seg.groupBy("meeting_id", F.coalesce("speaker", F.lit("Unknown")).alias("speaker")).agg(F.count(F.lit(1)).alias("n"))


def transcript_facts(seg: DataFrame) -> DataFrame:
    """Speakers with text, all speaker names, first start, last end and the span between."""
    at = F.struct("start_time", "seg_no")
    # names are made distinct first, so the list is as long as the cast, not the talk
    names = seg.groupBy("meeting_id", "speaker").agg(
        F.max((strip("text") != "").cast("int")).alias("_spoke"), F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(at.alias("at"), F.col("start_time").alias("v"))).alias("_first"),
        F.max(F.struct(at.alias("at"), F.col("end_time").alias("v"))).alias("_last"),
    )
    facts = names.groupBy("meeting_id").agg(
        F.sum("_spoke").alias("speakers_with_text"), F.array_sort(F.collect_list("speaker")).alias("speakers"),
        F.sum("_n").alias("segments"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
    )
    return facts.select(
        "meeting_id", "speakers_with_text", "speakers", "segments", F.col("_first.v").alias("first_start"),
        F.col("_last.v").alias("last_end"), (F.col("_last.v") - F.col("_first.v")).alias("span"),
    )


def transcript_timestamps(seg: DataFrame) -> DataFrame:
    """All starts of a meeting and its last end, one row per mark."""
    starts = seg.select("meeting_id", "start_time").withColumnRenamed("start_time", "mark")
    return starts.unionByName(transcript_facts(seg).select("meeting_id", F.col("last_end").alias("mark")))


# --- retrieval ------------------------------------------------------------------------------------------

def search_segments(seg: DataFrame, keyword: str, skip: int = 0, limit: int = 50) -> DataFrame:
    """Segments that contain a keyword, with the number of all matches."""
    found = seg.filter(F.contains(F.lower("text"), F.lit(keyword.lower())))
    total = found.agg(F.count(F.lit(1)).alias("total")).scalar()
    return found.orderBy("meeting_id", "seg_no").offset(skip).limit(limit).withColumn("total", total)


def by_speaker(seg: DataFrame, speaker: str) -> DataFrame:
    return seg.filter(F.col("speaker") == speaker)


# --- joins ------------------------------------------------------------------------------------------------

def assign_speaker(tr: DataFrame, di: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Each transcript segment takes the speaker of the turn it overlaps most.

    Both sides are put on time grids whose cells double in width from ``bucket`` on. A row's
    level is the first whose cells are as wide as the row is long, so it touches few cells
    however long it is; it is also put on the wider grids that the other side of its meeting
    uses. A pair meets on the level of its longer row and is kept only in the cell where its
    overlap begins, so no pair is seen twice and none is deduplicated. Equal overlaps go to
    the turn that comes first. Meetings without transcript keep their turns as they are.
    """
    def graded(df: DataFrame) -> DataFrame:
        length = (F.col("_e") - F.col("_s")) / bucket
        return df.withColumn("_own", F.when(length > 1, F.ceil(F.log2(length))).otherwise(F.lit(0)).cast("int"))

    def cells(df: DataFrame, other: DataFrame) -> DataFrame:
        # a meeting uses a few dozen levels at most
        wider = other.groupBy("meeting_id").agg(F.collect_set("_own").alias("_wider"))
        levels = F.concat(F.array("_own"), F.filter(F.coalesce("_wider", F.array().cast("array<int>")), lambda x: x > F.col("_own")))
        rows = df.join(wider, "meeting_id", "left").withColumn("_level", F.explode(levels)).drop("_wider")
        width = F.pow(F.lit(2.0), F.col("_level")) * bucket
        return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.greatest("_s", "_e") / width))))

    left = graded(tr.select("meeting_id", "seg_no", F.col("start_time").alias("_s"), F.col("end_time").alias("_e")))
    # turns over the same stretch tie everywhere, so only the first of them can win
    turns = di.groupBy("meeting_id", F.col("start_time").alias("_s"), F.col("end_time").alias("_e")).agg(
        F.min(F.struct(F.col("seg_no").alias("n"), F.col("speaker").alias("who"))).alias("_t")
    )
    right = graded(turns.select("meeting_id", F.col("_t.n").alias("_turn"), F.col("_t.who").alias("_who"), "_s", "_e"))
    said = cells(right, left).withColumnsRenamed({"_s": "_ds", "_e": "_de", "_own": "_ds_own"})
    begin = F.greatest("_s", "_ds")
    pairs = cells(left, right).join(said, ["meeting_id", "_level", "_cell"]).filter(
        (F.col("_s") < F.col("_de")) & (F.col("_ds") < F.col("_e")) & (F.greatest("_own", "_ds_own") == F.col("_level"))
        & (F.floor(begin / (F.pow(F.lit(2.0), F.col("_level")) * bucket)) == F.col("_cell"))
    )
    overlap = F.least("_e", "_de") - begin
    best = pairs.filter(overlap > 0).groupBy("meeting_id", "seg_no").agg(
        F.max_by("_who", F.struct(overlap.alias("o"), (-F.col("_turn")).alias("t"))).alias("_who"), F.max(overlap).alias("overlap")
    )
    named = tr.join(best, ["meeting_id", "seg_no"], "left").withColumn("speaker", F.coalesce("_who", "speaker")).drop("_who")
    untold = di.join(tr.select("meeting_id").distinct(), "meeting_id", "left_anti")
    return named.unionByName(untold, allowMissingColumns=True)


def align_segments(turns: DataFrame, recognized: DataFrame) -> DataFrame:
    """Recognizer output to the turn it was cut from.

    ``recognized`` has ``turn_id, start, end, text, confidence``; a row with null start
    is a whole text without pieces. A turn with neither keeps its row, confidence 0.1.
    """
    rec = recognized.select(
        "turn_id", F.col("start").alias("_rs"), F.col("end").alias("_re"), F.col("text").alias("_rt"), F.col("confidence").alias("_rc")
    )
    j = turns.join(rec, "turn_id", "left")
    piece, whole = F.col("_rs").isNotNull(), F.col("_rt").isNotNull() & (F.col("_rt") != "")
    return j.select(
        "meeting_id", "turn_id", "speaker",
        F.when(piece, F.round(F.col("start_time") + F.col("_rs"), 2)).otherwise(F.col("start_time")).alias("start_time"),
        F.when(piece, F.round(F.least(F.col("start_time") + F.col("_re"), F.col("end_time")), 2)).otherwise(F.col("end_time")).alias("end_time"),
        F.when(piece | whole, strip("_rt")).otherwise(F.col("text")).alias("text"),
        F.when(piece, F.coalesce("_rc", F.lit(0.5))).when(whole, F.col("confidence") * 0.9).otherwise(F.lit(0.1)).alias("confidence"),
    )


# --- text forms ------------------------------------------------------------------------------------------

def formatted_lines(seg: DataFrame, pack: RulePack = ZH) -> DataFrame:
    """``speaker: cleaned text`` per nonblank segment, in order of ``seg_no``."""
    cleaned = seg.filter(strip("text") != "").withColumn("_clean", clean_text(strip("text"), pack)).filter(F.col("_clean") != "")
    return cleaned.select("meeting_id", "seg_no", F.concat_ws(": ", F.coalesce("speaker", F.lit("UNKNOWN")), "_clean").alias("line"))


def to_srt(seg: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """One subtitle cue per segment, numbered from 1 within the meeting."""
    rows = number_rows(seg, KEY, ["seg_no"], "_i", target)
    times = F.concat_ws(" --> ", clock("start_time"), clock("end_time"))
    cue = F.concat_ws("\n", (F.col("_i") + 1).cast("string"), times, F.col("text"))
    return rows.select("meeting_id", (F.col("_i") + 1).alias("cue_no"), cue.alias("cue"))



def to_vtt(seg: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """One WebVTT cue per segment, numbered from 1 within the meeting; row 0 is the head of the file."""
    rows = number_rows(seg, KEY, ["seg_no"], "_i", target)
    point = lambda c: F.replace(clock(c), F.lit(","), F.lit("."))
    cue = F.concat_ws("\n", F.concat_ws(" --> ", point("start_time"), point("end_time")), F.col("text"))
    cues = rows.select("meeting_id", (F.col("_i") + 1).alias("cue_no"), cue.alias("cue"))
    head = seg.select("meeting_id", F.lit(0).cast("bigint").alias("cue_no"), F.lit("WEBVTT").alias("cue")).distinct()
    return head.unionByName(cues)
