"""Rule extraction from texts: tasks, names, organizations, dates.

Frames carry their key columns plus ``text``; a key may have many rows (the segments
of a meeting), told apart by ``seg_no``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.dates import date_type, parse_absolute, parse_entity_phrase, parse_task_phrase
from colloquy.functions.text import WS, bind, find_all, has_any, normalize_task, squeeze, strip, task_candidates
from colloquy.packs import ZH, RulePack, TaskPattern


#: numbers added up at a time; the work for n numbers grows with n * BLOCK + (n / BLOCK) ** 2
BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Sums of an array's numbers up to each place: block by block, then the blocks' own sums before them."""
    whole = F.array().cast("array<int>")
    append = lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v))
    blocks = F.when(F.size(numbers) > 0, F.transform(F.sequence(F.lit(0), F.size(numbers) - 1, F.lit(BLOCK)), lambda i: F.slice(numbers, i + 1, F.lit(BLOCK))))
    inner = F.transform(F.coalesce(blocks, F.array().cast("array<array<int>>")), lambda b: F.aggregate(b, whole, append))

    # the blocks' sums are bound before they are used in the inner function
    return bind(inner, lambda sums: bind(F.aggregate(F.transform(sums, lambda b: F.element_at(b, -1)), whole, append), lambda before: F.flatten(
        F.transform(sums, lambda b, k: F.transform(b, lambda v: v + F.when(k > 0, F.get(before, k - 1)).otherwise(0)))
    )))


def occurrences(col, pattern: str) -> Column:
    """array<struct<text,start,end>> of the matches, 0-based, left to right."""
    col = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    gaps = F.transform(F.split(col, pattern, -1), lambda g: F.length(g))
    # one gap before each match; the gap after the last one has no match and drops out
    pairs = F.filter(F.arrays_zip(find_all(col, pattern).alias("text"), gaps.alias("gap")), lambda m: m["text"].isNotNull())

    def placed(found: Column) -> Column:
        ends = running_sums(F.transform(found, lambda m: m["gap"] + F.length(m["text"])))
        return F.zip_with(found, ends, lambda m, e: F.struct(m["text"].alias("text"), (e - F.length(m["text"])).alias("start"), e.alias("end")))

    return bind(pairs, placed)


# --- tasks ------------------------------------------------------------------------------------

def _describe(p: TaskPattern, part, pack: RulePack) -> Column:
    text = part(p.task)
    if p.owner:
        text = F.concat(part(p.owner), F.lit(pack.owner_link), text)
    if p.due:
        text = F.concat(text, F.lit(pack.due_open), part(p.due), F.lit(pack.due_close))
    return normalize_task(text, pack)


def good_assignee(name: Column, pack: RulePack) -> Column:
    return name.rlike(pack.assignee_regex) & ~name.isin(*pack.assignee_block) & ~has_any(name, pack.assignee_noise)


def good_description(desc: Column, pack: RulePack) -> Column:
    return (
        F.length(desc).between(6, 80) & ~desc.rlike("SPEAKER_|\\[|\\]")
        & ~has_any(desc, pack.task_noise) & desc.rlike(pack.task_verbs)
    )


def task_fits(s: Column, pack: RulePack = ZH) -> Column:
    """array of (pattern, description, assignee, due_text): the pack's patterns that a candidate sentence fits."""
    def fitted(i: int, p: TaskPattern) -> Column:
        part = lambda g: strip(F.regexp_extract(s, p.regex, g))
        none = F.lit(None).cast("string")
        return F.when(s.rlike(p.regex), F.struct(
            F.lit(i).alias("pattern"), _describe(p, part, pack).alias("description"),
            (F.regexp_extract(s, p.regex, p.owner) if p.names_assignee else none).alias("assignee"),
            (F.regexp_extract(s, p.regex, p.due) if p.due else none).alias("due_text"),
        ))

    return F.filter(F.array(*[fitted(i, p) for i, p in enumerate(pack.task_patterns)]), lambda t: t.isNotNull())


def known_assignee(name: Column, pack: RulePack = ZH) -> Column:
    return F.when(good_assignee(name, pack), name)


def extract_tasks(df: DataFrame, key: Sequence[str], as_of, pack: RulePack = ZH) -> DataFrame:
    """Task rows found by the pack's sentence patterns; one sentence may fit several."""
    order = [c for c in ("seg_no",) if c in df.columns]
    rows = df.select(*key, *order, F.posexplode(task_candidates("text", pack)).alias("_pos", "_s"))
    # the outer form computes the fits once: no filter on their number is inferred
    fits = rows.select(*key, *order, "_pos", "_s", F.explode_outer(task_fits(F.col("_s"), pack)).alias("_t")).filter(F.col("_t").isNotNull())
    found = fits.select(
        *key, *order, "_pos", F.length("_s").alias("match_length"), has_any("_s", pack.score_verbs).alias("has_verb"), "_t.*"
    )
    found = found.filter(good_description(F.col("description"), pack))
    place = F.struct(*order, "_pos", "pattern")
    return found.withColumn("assignee", known_assignee(F.col("assignee"), pack)).withColumn("pos", place).withColumn(
        "due_date", parse_task_phrase("due_text", as_of, pack.due_phrases)
    ).drop("_pos", *order)


def task_priority(desc, pack: RulePack = ZH) -> Column:
    d = F.lower(F.col(desc) if isinstance(desc, str) else desc)
    return F.when(has_any(d, pack.high), "high").when(has_any(d, pack.medium), "medium").otherwise("low")


def task_confidence(assignee: Column, due_text: Column, match_length: Column, has_verb: Column) -> Column:
    """The score is summed in hundredths, so it is exact."""
    points = (
        F.lit(70) + F.when(assignee.isNotNull(), 10).otherwise(0) + F.when(due_text.isNotNull(), 10).otherwise(0)
        + F.when(match_length > 20, 5).when(match_length < 10, -10).otherwise(0) + F.when(has_verb, 5).otherwise(0)
    )
    return F.least(points, F.lit(95)) / 100


def score_tasks(found: DataFrame, pack: RulePack = ZH, min_confidence: float = 0.6) -> DataFrame:
    """Priority and confidence."""
    points = task_confidence(*[F.col(c) for c in ("assignee", "due_text", "match_length", "has_verb")])
    scored = found.withColumn("priority", task_priority("description", pack)).withColumn("confidence", points)
    return scored.filter(F.col("confidence") >= min_confidence)


def description_key(col) -> Column:
    return F.regexp_replace(F.lower(strip(col)), f"[，。！？、；:{WS[1:-1]}]+", "")


def dedupe_tasks(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per normalized description: the most confident, first on ties, at the first place."""
    rest = [c for c in scored.columns if c not in key]
    best = scored.groupBy(*key, description_key(F.col("description")).alias("_k")).agg(
        F.min("pos").alias("_first"),
        F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("c"), "pos")).alias("_b"),
    )
    kept = [F.col(f"_b.{c}").alias(c) for c in rest if c != "pos"]
    return best.select(*key, *kept, F.col("_first").alias("pos"))


def rule_tasks(df: DataFrame, key: Sequence[str], as_of, pack: RulePack = ZH, min_confidence: float = 0.6) -> DataFrame:
    return dedupe_tasks(score_tasks(extract_tasks(df, key, as_of, pack), pack, min_confidence), key)


def hybrid_tasks(model: DataFrame, rules: DataFrame, key: Sequence[str], mode: str = "hybrid") -> DataFrame:
    """Model and rule tasks together, model first per key, or the model's alone."""
    if mode == "llm_only":
        return dedupe_tasks(model, key)
    if mode == "llm_first":
        rules = rules.join(model.select(*key).distinct(), list(key), "left_anti")
    elif mode != "hybrid":
        raise ValueError(f"unknown mode {mode}")
    m = model.withColumn("pos", F.struct(F.lit(0).alias("source"), "pos"))
    r = rules.withColumn("pos", F.struct(F.lit(1).alias("source"), "pos"))
    return dedupe_tasks(m.unionByName(r, allowMissingColumns=True), key)


def due_hints(text, as_of, pack: RulePack = ZH, reach: int = 8) -> Column:
    """Distinct dates of the phrases that have a due word within ``reach`` characters."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def near(m: Column) -> Column:
        lo = F.greatest(m["start"] - reach, F.lit(0))
        around = F.substring(text, lo + 1, m["end"] + reach - lo)
        value = F.coalesce(parse_task_phrase(m["text"], as_of, pack.due_phrases), parse_absolute(m["text"], as_of))
        return F.when(has_any(around, pack.due_context), value)

    return F.array_distinct(F.filter(F.transform(occurrences(text, pack.due_hint), near), lambda d: d.isNotNull()))


def refine_tasks(
    items: DataFrame, key: Sequence[str], hints: DataFrame | None = None, pack: RulePack = ZH,
    model_first: bool = False, top: int = 12,
) -> DataFrame:
    """The second filter on extracted tasks, at most ``top`` per key.

    ``hints`` has one row per key with ``hint_count`` and ``hint``: a single due hint
    of a text is adopted by tasks without a date.
    """
    d = items.withColumn("description", squeeze(F.coalesce("description", F.lit(""))))
    if hints is not None:
        d = d.join(hints.select(*key, "hint_count", "hint"), list(key), "left")
    else:
        d = d.withColumn("hint_count", F.lit(0)).withColumn("hint", F.lit(None).cast("timestamp_ntz"))
    desc, link = F.col("description"), F.col("description").contains(pack.owner_link)

    def bad_name(n: Column) -> Column:
        noise = has_any(n, (*pack.refine_noise, *pack.refine_function_words))
        return n.isin(*pack.refine_block) | noise | ~n.rlike("^[A-Za-z\\x{4e00}-\\x{9fff}]{2,8}$")

    stated = F.nullif(F.regexp_extract(desc, pack.refine_owner_regex, 1), F.lit(""))
    intent, verb = has_any(desc, pack.refine_intents), has_any(desc, pack.refine_verbs)
    keep = (
        ~F.coalesce(bad_name(stated), F.lit(False)) & (F.col("confidence") >= (0.65 if model_first else 0.75))
        & F.length(desc).between(8, 80) & ~has_any(desc, pack.refine_chatter)
        & ((verb | intent) if model_first else verb)
    )
    d = d.filter(keep)
    assignee = F.coalesce(F.col("assignee"), F.lit(""))
    if not model_first:
        strict_owner = F.regexp_extract(desc, pack.refine_strict_regex, 1)
        strict_task = F.btrim(F.regexp_extract(desc, pack.refine_strict_regex, 2), F.lit(" ，,"))
        d = d.filter(~link | ((strict_owner != "") & ~has_any(strict_task, pack.refine_vague)))
        assignee = F.when(link & (assignee == ""), strict_owner).otherwise(assignee)
    words = F.transform(find_all(desc, pack.refine_word), F.lower)
    d = d.filter((F.size(words) < 6) | (F.size(F.array_distinct(words)) / F.size(words) >= 0.45))
    who = F.when((assignee == "") | bad_name(assignee), F.lit(None)).otherwise(assignee)
    adopted = F.when((F.col("hint_count") == 1) & (link | intent), F.col("hint"))
    d = d.withColumn("assignee", who).withColumn("due_date", F.coalesce("due_date", adopted))
    dated, owned = F.col("due_date").isNotNull(), F.col("assignee").isNotNull()
    d = d.filter((dated | owned | intent) & ~((F.lower("priority") == "low") & ~dated & ~owned) & ~desc.rlike("SPEAKER_|\\[|\\]"))
    same = F.regexp_replace(desc, f"[，。！？；:：{WS[1:-1]}]+", "")
    rest = [c for c in d.columns if c not in (*key, "hint_count", "hint")]
    first = d.groupBy(*key, same.alias("_k")).agg(F.min_by(F.struct(*rest), "pos").alias("_b")).select(*key, "_b.*")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    return ranked.filter(F.col("rank") <= top)


# --- entities ------------------------------------------------------------------------------------

def names(col, pack: RulePack = ZH) -> Column:
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    runs = find_all(text, pack.name_regex)
    led = lambda n: n.rlike("^" + pack.surnames)
    plain = F.filter(runs, lambda n: led(n) & ~n.isin(*pack.name_stop))
    titled = [
        F.flatten(F.transform(
            F.regexp_extract_all(text, F.lit(f"({pack.titled_surnames}){t}"), F.lit(1)),
            (lambda title: lambda n: F.array(F.concat(n, F.lit(title)), n))(t),
        ))
        for t in pack.titles_kept
    ]
    bare = [F.regexp_extract_all(text, F.lit(f"({pack.name_regex}){t}"), F.lit(1)) for t in pack.titles_dropped]
    rest = F.array_distinct(F.filter(F.slice(runs, 1, 5), led))
    return bind(F.array_distinct(F.concat(plain, *titled, *bare)), lambda n: F.when(F.size(n) > 0, n).otherwise(rest))


def organizations(col, pack: RulePack = ZH) -> Column:
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in pack.org_regexes])
    return F.array_distinct(F.filter(found, lambda o: F.length(o) >= 2))


def time_expressions(col, pack: RulePack = ZH) -> Column:
    """array<struct<text,start,end,kind>> of time words."""
    found = F.flatten(F.array(*[occurrences(col, p) for p in pack.time_regexes]))
    return F.transform(found, lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), date_type(m["text"]).alias("kind")))


def date_mentions(col, as_of, pack: RulePack = ZH) -> Column:
    """array<struct<text,start,end,kind,date>>: listed date shapes, then parsed time words."""
    def mention(m: Column, value: Column) -> Column:
        return F.struct(
            m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), date_type(m["text"]).alias("kind"), value.alias("date")
        )

    shapes = F.flatten(F.array(*[occurrences(col, p) for p in pack.date_regexes]))
    listed = F.transform(shapes, lambda m: mention(m, parse_absolute(m["text"], as_of)))
    relative = F.transform(
        F.filter(time_expressions(col, pack), lambda m: m["kind"].isin("relative", "quarter")),
        lambda m: mention(m, parse_entity_phrase(m["text"], as_of)),
    )
    return F.concat(listed, F.filter(relative, lambda m: m["date"].isNotNull()))


# Confidence of each entity type.
ENTITY_CONFIDENCE = (("PERSON", 0.8), ("ORG", 0.78), ("DATE", 0.82))


def entities(df: DataFrame, key: Sequence[str], as_of, types: Sequence[str] | None = None, pack: RulePack = ZH) -> DataFrame:
    """Typed entity rows, each (text, type) once per row of ``df``, at its first place."""
    lists = {
        "PERSON": names("text", pack), "ORG": organizations("text", pack),
        "DATE": F.transform(date_mentions("text", as_of, pack), lambda m: m["text"]),
    }
    wanted = [(k, c) for k, c in ENTITY_CONFIDENCE if not types or k in types]
    parts = []
    for kind, conf in wanted:
        clean = F.array_distinct(F.filter(F.transform(lists[kind], strip), lambda v: v != ""))
        parts.append(F.transform(clean, (lambda k, c: lambda v: F.struct(v.alias("entity"), F.lit(k).alias("type"), F.lit(c).alias("confidence")))(kind, conf)))
    order = [c for c in ("seg_no",) if c in df.columns]
    rows = df.select(*key, *order, "text", F.explode(F.concat(*parts)).alias("_e"))
    start = F.position(F.col("_e.entity"), F.col("text")) - 1
    found = rows.select(*key, *order, "_e.*", F.greatest(start, F.lit(0)).cast("bigint").alias("start"))
    return found.withColumn("end", F.col("start") + F.length("entity"))


def tasks_with_entities(df: DataFrame, key: Sequence[str], as_of, pack: RulePack = ZH) -> DataFrame:
    """Task spans by the entity patterns with the names and organizations inside them."""
    spans = F.flatten(F.array(*[
        F.transform(occurrences("text", p), (lambda i: lambda m: F.struct(F.lit(i).alias("pattern"), m["text"].alias("span"), m["start"].alias("start"), m["end"].alias("end")))(i))
        for i, p in enumerate(pack.entity_task_regexes)
    ]))
    order = [c for c in ("seg_no",) if c in df.columns]
    rows = df.select(*key, *order, F.explode(spans).alias("_s")).select(*key, *order, "_s.*")
    return rows.select(
        *key, *order, "pattern", strip("span").alias("description"), "start", "end",
        names("span", pack).alias("names"), organizations("span", pack).alias("organizations"),
    )

