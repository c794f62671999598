"""Extractive summaries and the rule-based parts they are made of.

Texts may be spread over many rows of one key (segments of a meeting); the order
within a key is ``seg_no`` where present, then the place inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.text import has_any, sentences, shorten, strip, strip_tags, tokens
from colloquy.packs import ZH, RulePack
from colloquy.plans.hot import place_texts


def _order(df: DataFrame) -> list[str]:
    return [c for c in ("seg_no",) if c in df.columns]


def _first(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``pos``; the group limit runs before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    return ranked.filter(F.col("rank") <= n)


def sentence_rows(df: DataFrame, key: Sequence[str], pack: RulePack = ZH, max_len: int | None = 80) -> DataFrame:
    order = _order(df)
    rows = df.select(*key, *order, F.posexplode(sentences(strip_tags("text") if max_len else F.col("text"), pack, max_len)).alias("_i", "sentence"))
    return rows.select(*key, F.struct(*order, "_i").alias("pos"), "sentence")


def lead_summary(col, n: int = 3, pack: RulePack = ZH) -> Column:
    s = F.array_join(F.slice(sentences(col, pack), 1, n), pack.stop_mark)
    done = s.rlike("[" + "".join(pack.final_marks) + "]$")
    return F.when((s != "") & ~done, F.concat(s, F.lit(pack.stop_mark.strip()))).otherwise(s)


# Share of the sentences a summary keeps.
RATIOS = {"short": 0.2, "medium": 0.35, "long": 0.5}


def extractive_summary(df: DataFrame, key: str = "doc_id", length: str = "medium", pack: RulePack = ZH) -> DataFrame:
    """Sentences with the most frequent tokens, in their own order.

    One text per key. The text is put in place by key once; every step after that works
    on ``(key, ...)`` and stays in that placement.
    """
    ratio = RATIOS.get(length, RATIOS["medium"])
    placed = place_texts(df.select(key, strip("text").alias("text")).filter(F.col(key).isNotNull() & (F.col("text") != "")), key)
    split = placed.withColumn("_a", sentences("text", pack))
    short = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    # a text without sentences is one row without sentence and keeps its beginning
    rows = split.select(key, F.size("_a").alias("_n"), F.when(F.size("_a") == 0, short).alias("_bare"), F.posexplode_outer("_a").alias("_i", "_s"))
    words = rows.filter(F.col("_n") > 0).select(key, "_i", F.explode(tokens("_s", pack)).alias("_w"))
    counts = words.groupBy(key, "_i", "_w").agg(F.count(F.lit(1)).alias("_c"))
    in_text = F.sum("_c").over(Window.partitionBy(key, "_w"))
    lexical = counts.withColumn("_f", in_text).groupBy(key, "_i").agg(F.sum(F.col("_c") * F.col("_f")).alias("_lex"))
    # twentieths keep the position bonus exact
    score = F.coalesce("_lex", F.lit(0)) * 20 + F.col("_n") - F.col("_i")
    best = Window.partitionBy(key).orderBy(F.col("_score").desc(), "_i")
    target = F.greatest(F.lit(1), F.floor(F.col("_n") * ratio + 0.5))
    ranked = rows.join(lexical, [key, "_i"], "left").withColumn("_score", score).withColumn("_r", F.row_number().over(best))
    kept = ranked.filter(F.col("_r") <= target).groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("_i", "_s")))).alias("_k"), F.first("_n").alias("_n"), F.first("_bare").alias("_bare")
    )
    text = F.array_join("_k._s", pack.stop_mark)
    ended = text.rlike("[" + "".join(pack.final_marks) + "]$")
    summary = F.coalesce("_bare", F.when(ended, text).otherwise(F.concat(text, F.lit(pack.stop_mark.strip()))))
    return kept.select(
        key, summary.alias("summary"), F.col("_n").cast("bigint").alias("sentences"), F.size("_k").cast("bigint").alias("kept")
    )


def top_tokens(
    df: DataFrame, key: Sequence[str], k: int, pack: RulePack = ZH, variant: str = "token", stop: Sequence[str] = (),
    lower_stop: Sequence[str] = (), only_valid=None,
) -> DataFrame:
    """The ``k`` most frequent tokens of each key; ties by first occurrence."""
    order = [c for c in _order(df) if c not in key]
    rows = df.select(*key, *order, F.posexplode(tokens("text", pack, variant)).alias("_i", "token"))
    if stop:
        rows = rows.filter(~F.col("token").isin(*stop))
    if lower_stop:
        rows = rows.filter(~F.lower("token").isin(*lower_stop))
    counts = rows.groupBy(*key, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, "_i")).alias("first_pos"))
    if only_valid is not None:
        # after counting, so each word of a key is looked at once
        counts = counts.filter(only_valid(F.col("token")))
    best = Window.partitionBy(*key).orderBy(F.col("n").desc(), "first_pos")
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def topic_masks(text: Column, pack: RulePack = ZH) -> list[Column]:
    """Which topic keywords a text holds: one bit each, 62 to a number, so the rows of a key combine by ``bit_or``."""
    words = [w for _, ws in pack.topic_rules for w in ws]
    bits = [F.lit(0).cast("bigint")] * -(-max(1, len(words)) // 62)
    for i, w in enumerate(words):
        bits[i // 62] = bits[i // 62].bitwiseOR(F.when(F.contains(text, F.lit(w)), F.lit(1 << i % 62)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ruled_topics(masks: Sequence[str], pack: RulePack = ZH) -> Column:
    """array of (pos, name, keywords) of the rules with a bit in the masks, in the order of the rules."""
    words = [(r, w) for r, (_, ws) in enumerate(pack.topic_rules) for w in ws]

    def topic(r: int, name: str) -> Column:
        found = F.array_compact(F.array(*[F.when(F.col(masks[i // 62]).bitwiseAND(F.lit(1 << i % 62)) != 0, F.lit(w)) for i, (q, w) in enumerate(words) if q == r]))
        return F.when(F.size(found) > 0, F.struct(F.lit(r).alias("pos"), F.lit(name).alias("name"), F.slice(found, 1, 4).alias("keywords")))

    return F.array_compact(F.array(*[topic(r, name) for r, (name, _) in enumerate(pack.topic_rules)]))


def rule_topics(df: DataFrame, key: Sequence[str], pack: RulePack = ZH, top: int = 5) -> DataFrame:
    """Topics by keyword rules; frequent tokens fill up when fewer than two rules hit."""
    df = df.withColumn("text", strip_tags(F.coalesce("text", F.lit(""))))
    bits = topic_masks(F.col("text"), pack)
    names = [f"_m{n}" for n in range(len(bits))]
    masks = df.select(*key, *[b.alias(n) for b, n in zip(bits, names)]).groupBy(*key).agg(*[F.bit_or(n).alias(n) for n in names])
    hit = masks.select(*key, ruled_topics(names, pack).alias("_t"))
    by_rule = hit.select(*key, F.explode("_t").alias("_t")).select(*key, "_t.*")
    frequent = top_tokens(df, key, 8, pack, "keyword", stop=pack.keyword_stop)
    filler = frequent.filter(~F.col("token").isin(*pack.topic_skip)).join(hit.filter(F.size("_t") < 2).select(*key), list(key), "left_semi")
    filler = filler.select(*key, (F.col("rank") + len(pack.topic_rules)).alias("pos"), F.col("token").alias("name"), F.array("token").alias("keywords"))
    return _first(by_rule.unionByName(filler), key, top)


# the rules below take sentences of ``sentence_rows`` and ``clue_pieces``: of squeezed texts, without blanks at their ends

def _decision(s: Column, pack: RulePack) -> Column:
    """The text of a decision clue, else null."""
    return F.when(F.length(s).between(8, 90) & has_any(s, pack.decision_marks), shorten(s, 70))


def _issue(s: Column, pack: RulePack) -> Column:
    unclear = (
        F.length(s).between(10, 50) & has_any(s, pack.issue_marks) & has_any(s, pack.issue_context) & ~has_any(s, pack.issue_noise)
        & ~s.rlike("([\\x{4e00}-\\x{9fff}A-Za-z])\\1{4,}")
    )
    return F.when(unclear, shorten(s, 48))


def _actions(s: Column, pack: RulePack) -> Column:
    """array of ``owner - task`` clues with the weekday words of the sentence."""
    due = F.regexp_extract(s, pack.action_due_regex, 1)
    both = F.arrays_zip(
        F.regexp_extract_all(s, F.lit(pack.action_regex), F.lit(1)).alias("o"), F.regexp_extract_all(s, F.lit(pack.action_regex), F.lit(2)).alias("t")
    )

    def action(m: Column) -> Column:
        base = F.concat(m["o"], F.lit(pack.action_link), strip(m["t"]))
        return shorten(F.when(due != "", F.concat(base, F.lit(pack.due_open), due, F.lit(pack.due_close))).otherwise(base), 60)

    named = F.filter(both, lambda m: ~m["o"].isin(*pack.action_owner_block))
    found = F.length(s).between(6, 120) & s.rlike(pack.action_regex)
    return F.when(found, F.transform(named, action)).otherwise(F.array().cast("array<string>"))


def decisions(sents: DataFrame, key: Sequence[str], pack: RulePack = ZH, top: int = 4) -> DataFrame:
    found = sents.select(*key, "pos", _decision(F.col("sentence"), pack).alias("decision")).filter(F.col("decision").isNotNull())
    return _first(found, key, top)


def open_issues(sents: DataFrame, key: Sequence[str], pack: RulePack = ZH, top: int = 5) -> DataFrame:
    found = sents.select(*key, "pos", _issue(F.col("sentence"), pack).alias("issue")).filter(F.col("issue").isNotNull())
    return _first(found, key, top)


def action_clues(sents: DataFrame, key: Sequence[str], pack: RulePack = ZH, top: int = 4) -> DataFrame:
    found = sents.select(*key, "pos", F.posexplode(_actions(F.col("sentence"), pack)).alias("_j", "action"))
    return _first(found.select(*key, F.struct("pos", "_j").alias("pos"), "action"), key, top)


# How many findings of each kind a summary shows.
SHOWN = {"decision": 4, "issue": 5, "action": 4, "lead": 2, "token": 8, "row": 1}


def _clue(kind: str, j, name) -> Column:
    return F.struct(F.lit(kind).alias("kind"), j.cast("int").alias("j"), name.alias("name"))


def clue_pieces(text: Column, pack: RulePack = ZH) -> Column:
    """What a text is taken apart into: itself, its short sentences and its keyword tokens, as (kind, j, name)."""
    return F.concat(
        F.array(_clue("row", F.lit(0), text)),
        F.transform(sentences(text, pack, 80), lambda s, j: _clue("sentence", j, s)),
        F.transform(tokens(text, pack, "keyword"), lambda s, j: _clue("token", j, s)),
    )


def sentence_findings(piece: Column, pack: RulePack = ZH) -> dict[str, Column]:
    """What the rules say of a sentence piece, as columns of a projection, where shared steps are computed once."""
    s, said = piece["name"], piece["kind"] == "sentence"
    # only the first two sentences of a row can lead a summary
    lead = F.when(said & (piece["j"] < SHOWN["lead"]), shorten(s, 60))
    return {"_decision": F.when(said, _decision(s, pack)), "_issue": F.when(said, _issue(s, pack)), "_lead": lead, "_actions": F.when(said, _actions(s, pack))}


def clues(piece: Column, pack: RulePack = ZH) -> Column:
    """The clues of a piece as (kind, j, name): findings of a sentence, a token, or that there is a row."""
    one = F.lit(0)
    found = F.concat(
        F.array(*[_clue(kind, one, F.col(f"_{kind}")) for kind in ("decision", "issue", "lead")]), F.transform("_actions", lambda a, j: _clue("action", j, a))
    )
    word = F.array(_clue("token", one, piece["name"]))
    token = F.when(~piece["name"].isin(*pack.keyword_stop), word) if pack.keyword_stop else word
    return (
        F.when(piece["kind"] == "token", token).when(piece["kind"] == "sentence", F.filter(found, lambda v: v["name"].isNotNull()))
        .when(piece["kind"] == "row", F.array(_clue("row", one, F.lit(None).cast("string"))))
    )


def clue_rows(base: DataFrame, pieces: Column, found, pack: RulePack = ZH, steps: dict[str, Column] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """A row per clue from one look at each text: the columns of ``base``, piece, kind, name, pos, at and the topic masks.

    ``pos`` is the place (``_order`` columns, piece, clue). ``at`` repeats it for
    findings, which are listed one by one, and is null for clues that add up. ``steps``
    are columns of a piece that ``found`` reads beside the findings, ``carry`` further
    fields that it gives its clues.
    """
    order, piece = _order(base), F.col("piece")
    # the outer form lets no filter on the array's size be inferred, which would compute the array once more
    rows = base.withColumn("piece", F.explode_outer(pieces)).drop("text")
    steps = {**sentence_findings(piece, pack), **(steps or {})}
    rows = rows.withColumns(steps).withColumn("_c", F.explode_outer(found(piece))).filter(F.col("_c").isNotNull()).drop(*steps)
    rows = rows.withColumns({c: F.col(f"_c.{c}") for c in ("kind", "name", *carry)})
    rows = rows.withColumn("pos", F.struct(*order, F.col("piece.j").alias("_i"), F.col("_c.j").alias("_j"))).drop("_c")
    listed = F.col("kind").isin("decision", "issue", "action", "lead")
    masks = {f"_m{n}": F.when(F.col("kind") == "row", b) for n, b in enumerate(topic_masks(F.col("piece.name"), pack))}
    return rows.withColumns({"at": F.when(listed, F.col("pos")), **masks})


def clue_groups(rows: DataFrame, key: Sequence[str], *more: Column) -> DataFrame:
    """Clues of a key added up: how often, where first, and all rows' topic masks."""
    masks = [F.bit_or(c).alias(c) for c in rows.columns if c.startswith("_m")]
    return rows.groupBy(*key, "kind", "name", "at").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), *masks, *more)


def ranked_clues(groups: DataFrame, key: Sequence[str]) -> DataFrame:
    """The clues a summary shows: the most frequent, then the first of each kind; the group limit runs before the shuffle."""
    order = Window.partitionBy(*key, "kind").orderBy(F.col("n").desc(), "pos")
    ranked = groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(SHOWN.values()))
    return ranked.filter(F.col("rank") <= F.element_at(F.create_map(*[F.lit(v) for kv in SHOWN.items() for v in kv]), F.col("kind")))


def clue_lists(ranked: DataFrame) -> list[Column]:
    """Aggregates over the ranked clues of a key: its lists of findings, frequent tokens, and masks."""
    in_order = lambda rows: F.transform(F.array_sort(rows), lambda r: r["v"])
    lists = [
        in_order(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", F.col("name").alias("v"))))).alias(name)
        for kind, name in (("decision", "decisions"), ("issue", "open_issues"), ("action", "actions"), ("lead", "_lead"), ("token", "_tokens"))
    ]
    return [*lists, *[F.max(c).alias(c) for c in ranked.columns if c.startswith("_m")]]


def compose_summary(lists: DataFrame, pack: RulePack = ZH, top: int = 5) -> DataFrame:
    """Topics and sentences made of the lists of ``clue_lists``, in their place."""
    masks = [c for c in lists.columns if c.startswith("_m")]
    filler = F.filter(
        F.transform("_tokens", lambda w, i: F.struct((i + 1 + len(pack.topic_rules)).alias("pos"), w.alias("name"), F.array(w).alias("keywords"))),
        lambda t: ~t["name"].isin(*pack.topic_skip) if pack.topic_skip else F.lit(True),
    )
    out = lists.withColumn("_t", ruled_topics(masks, pack))
    out = out.withColumn("_t", F.slice(F.when(F.size("_t") < 2, F.concat("_t", filler)).otherwise(F.col("_t")), 1, top))
    out = out.withColumn("topics", F.transform("_t", lambda t: F.struct(t["name"].alias("name"), t["keywords"].alias("keywords"))))
    about, todo, decided = pack.summary_parts
    pieces = F.array_compact(F.array(
        F.when(F.size("topics") > 0, F.format_string(about, F.array_join(F.slice("topics.name", 1, 3), "、"))),
        F.when(F.size("actions") > 0, F.format_string(todo, F.size("actions"))),
        F.when(F.size("decisions") > 0, F.format_string(decided, F.size("decisions"))),
    ))
    pieces = F.when((F.size(pieces) == 0) & (F.size("_lead") > 0), F.array(F.array_join("_lead", "；"))).otherwise(pieces)
    out = out.withColumn("_parts", pieces)

    def ended(c: Column) -> Column:
        return F.when((c != "") & ~c.endswith("。"), F.concat(c, F.lit("。"))).otherwise(c)

    trimmed = lambda chars: (lambda p: F.btrim(p, F.lit(chars)))
    summary = ended(shorten(F.array_join(F.transform("_parts", trimmed("。； ")), "。"), 220))
    brief = ended(shorten(F.array_join(F.transform(F.slice("_parts", 1, 2), trimmed("。 ")), "；"), 120))
    out = out.withColumn("summary", summary).withColumn("executive_summary", F.coalesce(F.nullif(brief, F.lit("")), F.col("summary")))
    return out.drop("_parts", "_lead", "_tokens", "_t", *masks).withColumn("sentiment_overall", F.lit(0.0)).withColumn("summary_type", F.lit("extractive"))


def structured_summary(df: DataFrame, key: Sequence[str], pack: RulePack = ZH) -> DataFrame:
    """Topics, decisions, issues and actions of each key with the sentences made of them, from one look at the texts."""
    base = df.select(*key, *_order(df), strip_tags(F.coalesce("text", F.lit(""))).alias("text"))
    rows = clue_rows(base, clue_pieces(F.col("text"), pack), lambda p: clues(p, pack), pack)
    ranked = ranked_clues(clue_groups(rows, key), key)
    return compose_summary(ranked.groupBy(*key).agg(*clue_lists(ranked)), pack)


def summary_ok(df: DataFrame, pack: RulePack = ZH, summary: str = "summary", source: str = "source") -> Column:
    """Whether a generated summary may be shown; expects array columns for its lists."""
    text = strip(F.coalesce(F.col(summary), F.lit("")))
    lower = lambda c: F.array_distinct(F.transform(tokens(c, pack), F.lower))
    mine, theirs = lower(text), lower(F.col(source))
    touches = F.exists(mine, lambda w: F.contains(F.lower(F.coalesce(F.col(source), F.lit(""))), w))
    far_off = ~F.arrays_overlap(mine, theirs) & ~touches & (F.size(mine) >= 8) & (F.size(theirs) >= 20)
    refused = text.rlike("(?i)" + "|".join(pack.refusals)) if pack.refusals else F.lit(False)
    listed = (F.size("key_topics") >= 2) | (F.size("decisions") >= 1) | (F.size("open_issues") >= 1)
    return (F.length(text) >= 20) & ~refused & (listed | ~F.coalesce(far_off, F.lit(False)))
