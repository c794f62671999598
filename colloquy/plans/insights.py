"""The composed jobs: segment enrichment and the insights of a meeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.dates import parse_task_phrase
from colloquy.functions.text import clean_text, has_any, sentiment, sentiment_scores, strip, strip_tags, task_candidates
from colloquy.operators.extract import description_key, entities, good_description, known_assignee, task_confidence, task_fits, task_priority
from colloquy.operators.summary import SHOWN, clue_groups, clue_lists, clue_pieces, clue_rows, clues, compose_summary, ranked_clues, top_tokens
from colloquy.operators.topics import textrank
from colloquy.packs import ZH, RulePack
from colloquy.plans.hot import durable

MEETING = ["meeting_id"]


def process_transcript(
    seg: DataFrame, as_of: str, pack: RulePack = ZH, with_entities: bool = True, with_keywords: bool = True, with_sentiment: bool = True,
    ranked: bool = True,
) -> DataFrame:
    """Segments with their entities, three keywords and sentiment.

    Keywords are the best words by graph rank, weighted by it; a segment whose words have no
    neighbours, or every one without ``ranked``, takes its most frequent tokens, weighted by their numbers.
    """
    key = ["meeting_id", "seg_no"]
    out = seg.withColumn("text", strip(F.coalesce("text", F.lit("")))).withColumn("speaker", F.coalesce("speaker", F.lit("Unknown")))
    spoken = out.filter(F.col("text") != "")
    if with_entities:
        found = entities(spoken, MEETING, as_of, pack=pack).groupBy(*key).agg(
            F.array_sort(F.collect_list(F.struct("type", "start", "entity", "end", "confidence"))).alias("entities")
        )
        out = out.join(found, key, "left")
    if with_keywords:
        texts = spoken.select(*key, "text")
        words = top_tokens(texts, key, 3, pack).select(*key, F.lit(1).alias("_way"), "rank", "token", "n", F.col("n").cast("double").alias("weight"))
        if ranked:
            best = textrank(texts, key, k=3, pack=pack).withColumnsRenamed({"keyword": "token", "score": "weight"})
            words = words.unionByName(best.withColumn("_way", F.lit(0)), allowMissingColumns=True)
        listed = words.groupBy(*key, "_way").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "n", "weight"))).alias("_words"))
        best = listed.groupBy(*key).agg(F.min_by("_words", "_way").alias("keywords"))
        out = out.join(best, key, "left")
    if with_sentiment:
        out = out.withColumn("sentiment", F.when(F.col("text") != "", sentiment("text", pack)))
        out = out.withColumn("scores", sentiment_scores("sentiment.score"))
    return out


def meeting_topics(seg: DataFrame, k: int = 5, pack: RulePack = ZH) -> DataFrame:
    """The most frequent tokens of each meeting."""
    return top_tokens(seg, MEETING, k, pack)


PART_ROWS = 500


def _insight_groups(seg: DataFrame, as_of: str, pack: RulePack, min_confidence: float, part_rows: int) -> DataFrame:
    """All that the insights of a meeting are made of, from one look at each segment and one grouping.

    A segment's cleaned text gives the task candidates, its formatted line the sentences
    and tokens; rows of the kinds ``row``, ``text`` and ``speaker`` carry its sizes, texts
    and time. The texts travel once, in the rows of their part.
    """
    speaker = F.coalesce("speaker", F.lit("UNKNOWN"))
    cleaned = seg.select(*MEETING, "seg_no", speaker.alias("speaker"), "start_time", "end_time", clean_text(strip("text"), pack).alias("_clean"))
    line = F.when(F.col("_clean") != "", F.concat_ws(": ", "speaker", "_clean"))
    base = cleaned.withColumn("_line", line).withColumn("text", strip_tags(F.coalesce("_line", F.lit(""))))
    as_piece = lambda p, clean: F.struct(p["kind"].alias("kind"), p["j"].alias("j"), p["name"].alias("name"), clean.alias("clean"))
    none = F.lit(None).cast("struct<cleaned:string,formatted:string>")
    whole = F.struct(F.col("_clean").alias("cleaned"), F.col("_line").alias("formatted"))
    candidate = lambda s, j: F.struct(F.lit("candidate").alias("kind"), j.alias("j"), s.alias("name"), none.alias("clean"))
    pieces = F.concat(
        F.transform(clue_pieces(F.col("text"), pack), lambda p: as_piece(p, F.when(p["kind"] == "row", whole))),
        F.transform(task_candidates("_clean", pack), candidate),
    )
    nothing = F.struct(F.lit(None).cast("int").alias("pattern"), *[F.lit(None).cast("string").alias(c) for c in ("description", "assignee", "due_text")])
    part = F.floor(F.col("seg_no") / part_rows)

    def clue(kind: str, name: Column, j=0, fit=nothing) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(j).alias("j") if isinstance(j, int) else j.alias("j"), name.alias("name"), fit.alias("fit"))

    def found(p: Column) -> Column:
        tasks = F.transform("_fits", lambda t: clue("task", description_key(t["description"]), t["pattern"], t))
        said = F.transform(clues(p, pack), lambda c: F.struct(c["kind"].alias("kind"), c["j"].alias("j"), c["name"].alias("name"), nothing.alias("fit")))
        own = F.array(clue("speaker", F.col("speaker")), clue("text", part.cast("string")))
        return F.when(p["kind"] == "candidate", tasks).when(p["kind"] == "row", F.concat(said, own)).otherwise(said)

    fits = {"_fits": F.when(F.col("piece.kind") == "candidate", task_fits(F.col("piece.name"), pack))}
    rows = clue_rows(base.withColumn("pieces", pieces).drop("_clean", "_line"), F.col("pieces"), found, pack, fits, ("fit",)).drop("pieces")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    who, s = known_assignee(F.col("fit.assignee"), pack), F.col("piece.name")
    sure = task_confidence(who, F.col("fit.due_text"), F.length(s), has_any(s, pack.score_verbs))
    rows = rows.withColumn("confidence", of("task", sure))
    rows = rows.filter((F.col("kind") != "task") | (good_description(F.col("fit.description"), pack) & (F.col("confidence") >= min_confidence)))
    place = F.struct("seg_no", F.col("piece.j").alias("_pos"), F.col("fit.pattern").alias("pattern"))
    task = F.struct(
        "fit.pattern", "fit.description", who.alias("assignee"), parse_task_phrase("fit.due_text", as_of, pack.due_phrases).alias("due_date"),
        task_priority("fit.description", pack).alias("priority"), "confidence",
    )
    text = F.struct("seg_no", F.col("piece.clean.cleaned").alias("cleaned"), F.col("piece.clean.formatted").alias("formatted"))
    return clue_groups(
        rows, MEETING, F.sum(of("row", F.length("piece.clean.cleaned"))).alias("_chars"), F.min(of("row", F.col("start_time"))).alias("_from"),
        F.max(of("row", F.col("end_time"))).alias("_to"), F.sum(of("speaker", F.col("end_time") - F.col("start_time"))).alias("_secs"),
        F.min_by(of("task", task), of("task", F.struct((-F.col("confidence")).alias("c"), place.alias("p")))).alias("_task"),
        F.min(of("task", place)).alias("_first"), F.array_sort(F.collect_list(of("text", text))).alias("_texts"),
    )


def meeting_insights(seg: DataFrame, as_of: str, pack: RulePack = ZH, min_confidence: float = 0.6, part_rows: int = PART_ROWS) -> DataFrame:
    """Summary, topics, decisions, tasks, shares, sizes and both texts of each meeting, in parts.

    Tasks come from the cleaned text, the summary from the lines ``speaker: cleaned text``.
    A part holds the ``part_rows`` numbers of ``seg_no`` from a multiple on: their cleaned and
    formatted texts, a line per segment that has one, and the tasks first met there
    (``action_items``, all of them, without the filters of the task list). What is said
    of the whole meeting stands in its first part and is null in others.
    """
    # small beside the texts, and read by several steps
    groups = durable(_insight_groups(seg, as_of, pack, min_confidence, part_rows))
    kind = F.col("kind")
    ranked = ranked_clues(groups.filter(kind.isin(*SHOWN)), MEETING)
    rest = groups.filter(kind.isin("speaker", "task")).withColumn("rank", F.lit(1))
    spoken = F.struct(F.col("name").alias("speaker"), F.col("_secs").alias("secs"))
    first = lambda c, name: F.max(F.when(kind == "row", F.col(c))).alias(name)
    meeting = ranked.unionByName(rest.select(*ranked.columns)).groupBy(*MEETING).agg(
        *clue_lists(ranked), F.array_sort(F.collect_list(F.when(kind == "speaker", spoken))).alias("_spoken"), F.count_if(kind == "task").alias("tasks_found"),
        first("n", "segments"), first("_chars", "_chars"), first("_from", "_from"), first("_to", "_to"), first("pos", "_pos"),
    )
    total = F.aggregate("_spoken", F.lit(0.0), lambda t, s: t + s["secs"].cast("double"))
    shares = F.transform("_spoken", lambda s: F.struct(s["speaker"], F.round(F.when(F.col("_total") > 0, s["secs"] / F.col("_total") * 100).otherwise(s["secs"]), 2)))
    whole = compose_summary(meeting, pack).withColumn("_total", total).select(
        *MEETING, F.floor(F.col("_pos.seg_no") / part_rows).alias("part"), "segments", (F.col("_to") - F.col("_from")).alias("meeting_duration"),
        (F.col("_chars") + F.col("segments") - 1).alias("word_count"), "summary", "executive_summary", "topics", "decisions", "open_issues", "actions",
        "sentiment_overall", "summary_type", F.map_from_entries(shares).alias("speaker_contributions"), "tasks_found",
    )
    said = whole.columns[2:]
    texts = groups.filter(kind == "text").select(*MEETING, F.col("name").cast("bigint").alias("part"), "_texts")
    item = F.struct(F.col("_first").alias("pos"), "_task.*")
    tasks = groups.filter(kind == "task").select(*MEETING, F.floor(F.col("_first.seg_no") / part_rows).alias("part"), item.alias("_item"))
    # the three meet in one grouping; a part's texts are one row already
    both = texts.unionByName(tasks, allowMissingColumns=True).unionByName(whole.select(*MEETING, "part", F.struct(*said).alias("_said")), allowMissingColumns=True)
    parts = both.groupBy(*MEETING, "part").agg(
        F.first("_texts", True).alias("_texts"), F.array_sort(F.collect_list("_item")).alias("action_items"), F.first("_said", True).alias("_said")
    )
    joined = lambda field: F.array_join(F.filter(F.transform("_texts", lambda t: F.nullif(t[field], F.lit(""))), lambda t: t.isNotNull()), "\n").alias(field + "_text")
    return parts.select(*MEETING, "part", "_said.*", "action_items", joined("cleaned"), joined("formatted"))
