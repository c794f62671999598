"""Text rules as ``Column`` expressions (no Python runs per row)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from colloquy.packs import PROSE, ZH, RulePack  # noqa: F401 - PROSE re-exported for callers

# Unicode white space spelled out: Java's \s is ASCII-only, the rules are not.
WS = (
    "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
    "\\x{202f}\\x{205f}\\x{3000}]"
)
# the inside of that class, to be joined with other characters
_WS_SET = WS[1:-1]
# the same characters one by one, for trimming without a regex
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPEAKER_TAG = f"(?i)\\[{WS}*SPEAKER_[^\\]]+\\]{WS}*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, also where ``fn`` uses it many times or in a lambda."""
    return F.transform(F.array(value), fn)[0]


def quote(word: str) -> str:
    """A word as a regex literal that both Java and RE2 read the same way."""
    return re.sub(r"([\\.\[\]{}()*+?^$|/\-])", r"\\\1", word)


def any_of(words: Sequence[str]) -> str:
    """One alternation for a whole list, so the text is scanned once."""
    return "(" + "|".join(quote(w) for w in words) + ")"


def has_any(col, words: Sequence[str]) -> Column:
    """Whether one of the words occurs; they are literal, so no regex has to try them at every character."""
    return reduce(lambda a, b: a | b, [F.contains(_col(col), F.lit(w)) for w in words]) if words else F.lit(False)


def find_all(col, pattern: str) -> Column:
    return F.regexp_extract_all(_col(col), F.lit(pattern), F.lit(0))


def strip(col) -> Column:
    return F.btrim(_col(col), F.lit(WS_CHARS))


def squeeze(col) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.btrim(F.regexp_replace(_col(col), f"{WS}+", " "), F.lit(" "))


def blank_to_null(col) -> Column:
    return F.nullif(strip(col), F.lit(""))


# --- sentences, tokens ---------------------------------------------------------------

def _pieces(col: Column, pattern: str, chars: str) -> Column:
    parts = F.transform(F.split(col, pattern), lambda x: F.btrim(x, F.lit(chars)))
    return F.filter(parts, lambda x: x != "")


def sentences(col, pack: RulePack = ZH, max_len: int | None = None, piece_len: int = 70) -> Column:
    """Sentences of a text; with ``max_len`` long ones are cut at clauses, then by length."""
    col = F.coalesce(_col(col), F.lit(""))
    plain = _pieces(col, pack.sentence_break, pack.trim_chars)
    if max_len is None:
        return plain

    def hard_cut(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / piece_len).cast("int"))
        cut = F.transform(starts, lambda i: F.btrim(F.substring(c, i * piece_len + 1, F.lit(piece_len)), F.lit(pack.trim_chars)))
        return F.when(F.length(c) <= max_len, F.array(c)).otherwise(F.filter(cut, lambda x: x != ""))

    def clauses(s: Column) -> Column:
        parts = _pieces(s, pack.clause_break, pack.trim_chars)
        return F.when(F.length(s) <= max_len, F.array(s)).otherwise(F.flatten(F.transform(parts, hard_cut)))

    return F.flatten(F.transform(plain, clauses))


def strip_tags(col) -> Column:
    return squeeze(F.regexp_replace(_col(col), SPEAKER_TAG, ""))


def normalize_task(col, pack: RulePack = ZH) -> Column:
    c = F.regexp_replace(_col(col), SPEAKER_TAG, "")
    c = F.regexp_replace(c, "(?i)(^|[^A-Za-z0-9_])SPEAKER_\\d+", "$1")
    c = F.btrim(F.regexp_replace(c, f"{WS}+", " "), F.lit(" ，,。；;:："))
    return F.regexp_replace(c, f"^{any_of(pack.lead_fillers)}{WS}*", "")


def task_candidates(col, pack: RulePack = ZH) -> Column:
    """Normalized sentences, cut at every clause mark."""
    parts = F.transform(F.split(F.coalesce(_col(col), F.lit("")), pack.sentence_break), lambda x: normalize_task(x, pack))
    clauses = F.flatten(F.transform(parts, lambda s: F.split(s, pack.clause_break)))
    return F.filter(F.transform(clauses, lambda x: normalize_task(x, pack)), lambda x: x != "")


def tokens(col, pack: RulePack = ZH, variant: str = "token") -> Column:
    """``variant`` is token, topic or keyword: the three token shapes of a pack."""
    pattern = {"token": pack.token, "topic": pack.topic_token, "keyword": pack.keyword_token}[variant]
    return find_all(F.coalesce(_col(col), F.lit("")), pattern)


def shorten(col, n: int, trailing: str = "，,。；; ") -> Column:
    c = strip(F.coalesce(_col(col), F.lit("")))
    return F.when(F.length(c) <= n, c).otherwise(
        F.concat(F.rtrim(F.substring(c, 1, n), F.lit(trailing)), F.lit("..."))
    )


def squash(col, pack: RulePack = ZH) -> Column:
    """A character repeated four or more times once; listed doubled phrases halved."""
    c = F.regexp_replace(_col(col), "(?s)(.)\\1{3,}", "$1")
    return reduce(lambda acc, p: F.replace(acc, F.lit(p), F.lit(p[:2])), pack.doubled, c)


def safe_name(col) -> Column:
    c = F.coalesce(F.nullif(_col(col), F.lit("")), F.lit("audio.wav"))
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def speaker_index(col) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_col(col), F.lit("")), "([0-9]+)$", 1), F.lit("")).try_cast("bigint")


# --- cleaning --------------------------------------------------------------------------

_END = ("。", "？", "！", "；", "…")


def clean_rules(pack: RulePack = ZH) -> list[tuple[str, str]]:
    """The cleaning rules as ordered (regex, replacement) pairs: the definition of ``unify``."""
    rules = [(quote(w), "") for w in pack.redundant]
    rules += [(f"{WS}+", " "), ("^ +| +$", "")]
    rules += [(quote(a), b) for a, b in pack.punctuation]
    rules += [("([。？！；，])\\1+", "$1")]
    rules += [(f"{o}，", o) for o in pack.ordinals]
    rules += [(f"{WS}+，", "，"), (f"，{WS}+，", "，"), (f"。{WS}+，", "。"), (f"^{WS}*，", "")]
    return rules


def redundant_rules(pack: RulePack = ZH) -> list[tuple[str, str]]:
    """The filler list as (regex, replacement) pairs: single characters go with a mark after them."""
    rules = []
    for w in pack.redundant:
        rules += [(f"{quote(w)}[。，、；]?", ""), (quote(w), "")] if len(w) == 1 else [(f"{WS}*{quote(w)}{WS}*", " ")]
    return rules


def apply_rules(col, rules: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, _col(col))


def _drop_words(col: Column, pack: RulePack) -> Column:
    return reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), pack.redundant, col)


def _join_ordinals(col: Column, pack: RulePack) -> Column:
    return reduce(lambda acc, o: F.replace(acc, F.lit(f"{o}，"), F.lit(o)), pack.ordinals, col)


def unify(col, pack: RulePack = ZH) -> Column:
    """Fillers out, blanks squeezed, marks in one style and not repeated.

    Same result as ``clean_rules`` in order, with literal replacement where no regex is
    needed. Once blanks before a comma are gone, its rules on commas after blanks have
    nothing left to match.
    """
    c = squeeze(_drop_words(_col(col), pack))
    c = F.translate(c, "".join(a for a, _ in pack.punctuation), "".join(b for _, b in pack.punctuation))
    c = F.regexp_replace(c, "([。？！；，])\\1+", "$1")
    c = F.replace(_join_ordinals(c, pack), F.lit(" ，"), F.lit("，"))
    return F.regexp_replace(c, "^，", "")


def segment(col, max_len: int = 30, min_len: int = 5) -> Column:
    """Split after end marks; one overlong piece is cut by length; short neighbours merge."""
    return bind(F.coalesce(_col(col), F.lit("")), lambda c: _segment(c, max_len, min_len))


def _segment(col: Column, max_len: int, min_len: int) -> Column:
    parts = F.filter(
        F.transform(F.split(col, "(?<=[。？！；…])"), strip), lambda x: x != ""
    )
    # up to the last blank or comma in the later half of a full piece, else all of it
    whole, late = max_len, int(max_len * 0.5) + 1
    lengths = f"(?s)(?=.{{{whole}}}).{{{late},{whole - 1}}}[ ，,]|.{{{whole}}}|.{{1,{whole - 1}}}\\z"
    by_len = F.transform(F.regexp_extract_all(col, F.lit(lengths), F.lit(0)), strip)
    pieces = bind(parts, lambda p: F.when((F.size(p) <= 1) & (F.length(col) > max_len), by_len).otherwise(p))

    def merge_step(acc: Column, s: Column) -> Column:
        short = F.length(acc["cur"]) + F.length(s) < min_len
        return F.struct(
            F.when(short | (acc["cur"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["cur"])))).alias("out"),
            F.when(short, F.concat(acc["cur"], s)).otherwise(s).alias("cur"),
        )

    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    merged = F.aggregate(
        pieces, empty, merge_step,
        lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["cur"])))),
    )
    return F.filter(merged, lambda x: x != "")


def restore_marks(arr, pack: RulePack = ZH, third_is_statement: bool = False) -> Column:
    """End marks for unmarked sentences: a question mark when a question word occurs."""
    def mark(s: Column, i: Column) -> Column:
        done = s.rlike("[。？！；…]$")
        ended = F.when(s == "", F.lit("")).when(done, s).when(
            has_any(s, pack.question_words), F.concat(s, F.lit("？"))
        ).otherwise(F.concat(s, F.lit("。")))
        if third_is_statement:
            ended = F.when((i == 2) & ended.endswith("？"), F.regexp_replace(ended, "？$", "。")).otherwise(ended)
        return ended

    return F.transform(F.transform(_col(arr), strip), mark)


def clean_paragraphs(col, pack: RulePack = ZH) -> Column:
    """Line by line, sentence by sentence: fillers out, every sentence ended."""
    col = _col(col)

    def sentence(s: Column) -> Column:
        c = F.regexp_replace(_join_ordinals(_drop_words(s, pack), pack), f"{WS}+", " ")
        return F.btrim(F.regexp_replace(c, f"，{WS}*，", "，"), F.lit(" "))

    def paragraph(p: Column) -> Column:
        sents = F.filter(F.split(p, "。"), lambda s: strip(s) != "")
        cleaned = F.filter(F.transform(sents, sentence), lambda s: s != "")
        return F.array_join(F.transform(cleaned, lambda s: F.concat(s, F.lit("。"))), " ")

    return F.array_join(F.filter(F.transform(F.split(col, "\n"), paragraph), lambda p: p != ""), " ")


def clean_text(
    col, pack: RulePack = ZH, max_len: int = 30, min_len: int = 5, third_is_statement: bool = False,
    cut_sentences: bool = True, end_sentences: bool = True,
) -> Column:
    """Cleaned transcript text: fillers out, marks unified, sentences cut and ended."""
    col = _col(col)
    flat = unify(col, pack)
    if cut_sentences:
        flat = F.array_join(segment(flat, max_len, min_len), " ")
    if end_sentences:
        flat = F.array_join(restore_marks(F.split(flat, " "), pack, third_is_statement), " ")
    flat = bind(squeeze(flat), lambda f: F.when((f != "") & ~f.rlike("[。？！；…]$"), F.concat(f, F.lit("。"))).otherwise(f))
    return (
        F.when(col.isNull() | (strip(col) == ""), F.lit(""))
        .when(col.rlike(f"^[。？！；，{_WS_SET}]+$"), F.lit("。"))
        .when(has_any(col, pack.ordinals) & col.contains("\n"), clean_paragraphs(strip(col), pack))
        .otherwise(flat)
    )


# --- utterance and topic predicates -------------------------------------------------------

def is_low_value(col, pack: RulePack = ZH) -> Column:
    norm = F.lower(F.regexp_replace(F.coalesce(_col(col), F.lit("")), f"[{_WS_SET}，,。.!！？?；;:：\\-]+", ""))
    return bind(norm, lambda n: (
        (F.length(n) <= 2) | n.isin(*pack.fillers) | n.rlike("^[a-z]{1,4}$|([a-z\\x{4e00}-\\x{9fff}])\\1{3,}")
        | ((F.length(n) <= 5) & ~n.rlike(pack.script_char))
    ))


def is_informative(col, pack: RulePack = ZH, min_script: int = 12) -> Column:
    raw = strip(F.coalesce(_col(col), F.lit("")))
    return (raw != "") & (
        raw.rlike(any_of(pack.important) + "|" + pack.important_regex)
        | (F.regexp_count(raw, F.lit(pack.script_char)) >= min_script)
    )


def is_valid_topic(col, pack: RulePack = ZH) -> Column:
    name = F.btrim(strip(F.coalesce(_col(col), F.lit(""))), F.lit(' ，,.:;:!?！？。；【】[]()（）"'))
    bad = "(?i:SPEAKER_)|[0-9]{4,}|^[A-Za-z]{1,3}$|([A-Za-z\\x{4e00}-\\x{9fff}])\\1{3,}"
    return bind(name, lambda t: (
        F.length(t).between(2, 24) & ~F.lower(t).isin(*pack.topic_stop_lower) & ~t.isin(*pack.topic_stop) & ~t.rlike(bad)
    ))


# --- sentiment -----------------------------------------------------------------------------

def hits(col, words: Sequence[str]) -> Column:
    """The listed words that occur in the text, each once, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(_col(col), w))


def sentiment(col, pack: RulePack = ZH) -> Column:
    """struct(positive_count, negative_count, score, label)."""
    text = F.coalesce(_col(col), F.lit(""))
    pos, neg = (
        reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])
        for words in (pack.positive, pack.negative)
    )
    s = F.struct(pos.alias("p"), neg.alias("n"))
    raw = F.when(s["p"] + s["n"] == 0, F.lit(0.0)).otherwise((s["p"] - s["n"]) / (s["p"] + s["n"]))
    label = F.when(raw > 0.1, F.lit("positive")).when(raw < -0.1, F.lit("negative")).otherwise(F.lit("neutral"))
    return F.struct(
        s["p"].cast("bigint").alias("positive_count"),
        s["n"].cast("bigint").alias("negative_count"),
        F.round(raw, 2).alias("score"),
        label.alias("label"),
    )


def sentiment_scores(score) -> Column:
    """struct(positive, neutral, negative) from a score in [-1, 1]."""
    score = _col(score)

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    pos, neg = clamp(F.lit(0.5) + score / 2), clamp(F.lit(0.5) - score / 2)
    return F.struct(
        F.round(pos, 3).alias("positive"),
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(pos, neg)), 3).alias("neutral"),
        F.round(neg, 3).alias("negative"),
    )


def sentiment_band(score) -> Column:
    score = _col(score)
    return F.when(score < -0.3, F.lit("negative")).when(score <= 0.3, F.lit("neutral")).otherwise(F.lit("positive"))


# --- edit distance --------------------------------------------------------------------------

def word_errors(reference, hypothesis) -> Column:
    """Edit distance of two texts in words.

    The words of a pair are numbered and written as one character each, which turns
    the word distance into the built-in character distance.
    """
    def words(c) -> Column:
        return F.filter(F.split(F.coalesce(_col(c), F.lit("")), f"{WS}+"), lambda w: w != "")

    def distance(pair: Column) -> Column:
        # code points from 0x21 on, without the surrogates; a pair with more words than there are has no distance
        code = lambda n: F.when(n + 0x20 < 0xD800, n + 0x20).otherwise(n + 0x20 + 0x800)
        one = lambda w: F.decode(F.unhex(F.lpad(F.hex(code(F.array_position(pair["v"], w))), 8, "0")), "UTF-32")
        letters = lambda ws: F.array_join(F.transform(ws, one), "")
        fits = F.size(pair["v"]) <= 0x10FFFF - 0x820
        return F.when(fits, F.levenshtein(letters(pair["r"]), letters(pair["h"])).cast("bigint"))

    both = F.struct(words(reference).alias("r"), words(hypothesis).alias("h"))
    listed = bind(both, lambda p: F.struct(p["r"].alias("r"), p["h"].alias("h"), F.array_distinct(F.concat(p["r"], p["h"])).alias("v")))
    return bind(listed, distance)


# --- labels of durations and ages --------------------------------------------------------------

def format_duration(seconds, units: tuple[str, str, str] = ("小时", "分钟", "秒")) -> Column:
    """Words for hours, minutes and seconds; parts that are zero are left out."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(_col(seconds).cast("double"), F.lit(0.0)) + 0.5)).cast("bigint")
    parts = [F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60]
    words = [F.when(p > 0, F.concat(p.cast("string"), F.lit(u))) for p, u in zip(parts, units, strict=True)]
    return F.when(s == 0, F.lit("0" + units[2])).otherwise(F.concat_ws(" ", *words))


def clock(seconds, millis: bool = True) -> Column:
    """HH:MM:SS,mmm of a second count."""
    ms = F.round(_col(seconds).cast("double") * 1000).cast("bigint")
    base = [F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60]
    return F.format_string("%02d:%02d:%02d,%03d", *base, ms % 1000) if millis else F.format_string("%02d:%02d:%02d", *base)
