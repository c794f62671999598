"""URL filters: rules for hosts and paths, and word segmentation with naive Bayes where no rule fits.

Hosts and paths are cut at marks; a run of letters a to z is split into the words that
are most probable under unigram counts of the pages' own text (Viterbi over its
substrings). Runs of digits are tokens by their length, runs of other letters are
tokens as they stand. A multinomial naive Bayes model over these tokens learns from the urls
that the rules decide and judges the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import settle

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LONGEST_WORD = 20
#: least log-odds to block a url that no rule fits
MARGIN = 1.0
_RAW = re.compile(r"<(script|style)\b")
_CLOSE = {"script": re.compile(r"</script\s*>"), "style": re.compile(r"</style\s*>")}
_LETTERS = re.compile(r"[a-z]+")
#: runs longer than this go by their digests where their parts are counted
OWN_NAME = 64


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to a slash, question mark, hash or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does. Rules have no two of one name."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    # longer rules are asked first
    for verdict, domain, start in sorted(rules, key=lambda x: len(x[1] + x[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def runs_of(host: Column, path: Column) -> Column:
    """Runs of a host and path in their order, each as often as it occurs: letters a to z, digits (as zeros), other characters beyond ASCII."""
    text = F.translate(F.concat_ws(" ", host, F.lower(path)), "123456789", "000000000")
    return F.regexp_extract_all(text, F.lit(r"([a-z]+|0+|[^\x00-\x7F]+)"), F.lit(1))


def plain_text(html: str) -> str:
    """Lower-cased text outside tags, scripts and styles, in time linear in the html; a script without end is a plain tag, and a ``<`` without end is text."""
    html = html.lower()
    parts, at, endless = [], 0, set()
    while (begin := html.find("<", at)) >= 0:
        parts.append(html[at:begin])
        raw, end = _RAW.match(html, begin), None
        if raw and raw[1] not in endless:
            close = _CLOSE[raw[1]].search(html, raw.end())
            if close:
                end = close.end()
            else:
                endless.add(raw[1])
        if end is None:
            end = html.find(">", begin) + 1
        if not end:
            at = begin
            break
        at = end
    parts.append(html[at:])
    return " ".join(parts)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): words of a to z in the text of all pages, at most ``LONGEST_WORD`` letters; tags, scripts and styles do not count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column("html"):
                counts.update(x for x in _LETTERS.findall(plain_text(html.as_py() or "")) if len(x) <= LONGEST_WORD)
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    return pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def split_run(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of a run of letters; ties go to the longer last word.

    A letter that starts no known word is a word of its own, at a tenth of the
    probability per letter of a word met once.
    """
    size, unknown = len(run), math.log(total + 1.0) + math.log(10.0)
    best, back = [0.0] * (size + 1), [0] * (size + 1)
    gains = {word: math.log(n) - math.log(total) for word, n in counts.items() if n}
    for end in range(1, size + 1):
        least, place = -math.inf, end - 1
        for begin in range(max(0, end - LONGEST_WORD), end):
            gain = gains.get(run[begin:end])
            if gain is None:
                if end - begin > 1:
                    continue
                gain = -unknown
            if best[begin] + gain > least:
                least, place = best[begin] + gain, begin
        best[end], back[end] = least, place
    words, end = [], size
    while end:
        words.append(run[back[end]: end])
        end = back[end]
    return words[::-1]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, word) for the distinct substrings of runs, a bounded number at a time; a long run repeats some of them."""
    for batch in batches:
        names: list[str] = []
        words: list[str] = []
        for name, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for low in range(0, len(run), 4096):
                found = {run[k: k + n] for k in range(low, min(low + 4096, len(run))) for n in range(1, min(LONGEST_WORD, len(run) - k) + 1)}
                words.extend(found)
                names.extend([name] * len(found))
                if len(words) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string())], names=["name", "word"])
                    names, words = [], []
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string())], names=["name", "word"])


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of the distinct runs in the rows (run) that are letters a to z.

    Each run's substrings meet the counts in a join, so that no task holds the word
    list; a run comes back with those of its substrings that are words. A long run is
    named by its digest on the way, so its substrings don't carry it.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    name = F.when(F.length("run") <= OWN_NAME, F.col("run")).otherwise(F.concat(F.lit("#"), F.sha2("run", 256)))
    named = runs.where(F.col("run").rlike("^[a-z]")).select("run").distinct().select(name.alias("name"), "run")
    parts = named.mapInArrow(_parts, "name string, word string").distinct()
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    found = named.join(known, "name", "left").select("run", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split_run(x, {y["word"]: y["n"] for y in known or ()}, max(1, total)) for x, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return found.mapInArrow(run, "run string, words array<string>")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, margin: float = MARGIN) -> DataFrame:
    """(page_id, host, path, rule, verdict, tokens, block_odds) of every row of (page_id, url, html).

    A rule decides where one fits. Elsewhere the sum of the tokens' log-odds and the
    prior, learned from all urls that rules decide, a token as often as it occurs, blocks a url from ``margin`` on. A
    null url, or one without ``://``, has empty host and path, no tokens and is
    allowed. Repeated rows are judged each, a null page_id is carried through, other
    columns are ignored, an empty table gives no rows; with rules of one verdict only,
    or none that fit, every other url is allowed.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("found", match_rules(F.col("host"), F.col("path"), rules))
    # equal host and path are judged once, however many rows have them
    distinct = urls.groupBy("host", "path").agg(F.count("*").alias("rows"), F.first("found").alias("found"))
    distinct = settle(distinct.select("host", "path", "rows", "found.rule", "found.verdict"), "urls")
    counts = settle(word_counts(pages), "page-words")
    runs = distinct.select("host", "path", F.explode(runs_of(F.col("host"), F.col("path"))).alias("run")).groupBy("host", "path", "run").agg(F.count("*").alias("times"))
    words = settle(segmented(runs, counts), "segmented")
    pieces = runs.join(words, "run", "left").select("host", "path", F.flatten(F.array_repeat(F.coalesce("words", F.array("run")), F.col("times").cast("int"))).alias("words"))
    lists = pieces.groupBy("host", "path").agg(F.flatten(F.array_sort(F.collect_list("words"))).alias("tokens"))
    tokens = settle(distinct.join(lists, ["host", "path"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), "url-tokens")
    ruled = tokens.where("verdict is not null")
    weight = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("rows")).otherwise(0))
    seen = ruled.select("verdict", "rows", F.explode("tokens").alias("token")).groupBy("token").agg(weight("block").alias("block"), weight("allow").alias("allow"))
    seen = settle(seen, "url-counts")
    blocks, allows = ruled.agg(weight("block"), weight("allow")).first()
    in_block, in_allow, kinds = seen.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    certain = bool(blocks and allows)
    odds = seen.select("token", (F.log((F.col("block") + 1) / F.lit((in_block or 0) + kinds + 1)) - F.log((F.col("allow") + 1) / F.lit((in_allow or 0) + kinds + 1))).alias("odds"))
    prior = float(math.log(blocks / allows)) if certain else 0.0
    unseen = float(math.log(((in_allow or 0) + kinds + 1) / ((in_block or 0) + kinds + 1)))
    free = tokens.where("verdict is null")
    sums = free.select("host", "path", F.explode("tokens").alias("token")).join(odds, "token", "left")
    sums = sums.groupBy("host", "path").agg((F.sum(F.coalesce("odds", F.lit(unseen))) + prior).alias("block_odds"))
    judged = tokens.join(sums, ["host", "path"], "left")
    by_odds = F.when(F.lit(certain) & (F.col("host") != "") & (F.coalesce("block_odds", F.lit(0.0)) >= margin), "block").otherwise("allow")
    judged = judged.select("host", "path", "rule", F.coalesce("verdict", by_odds).alias("verdict"), "tokens", "block_odds")
    return urls.select("page_id", "host", "path").join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "tokens", "block_odds")
