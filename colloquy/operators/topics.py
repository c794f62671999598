"""Keywords and topics over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.text import hits, is_valid_topic, strip, tokens
from colloquy.operators.summary import top_tokens
from colloquy.packs import ZH, RulePack
from colloquy.plans.hot import durable, place_texts, same_key
from colloquy.session import ship


def keyword_tokens(col, pack: RulePack = ZH) -> Column:
    """Lower-case tokens of a text without stop words."""
    low = F.transform(tokens(col, pack), F.lower)
    return F.filter(low, lambda w: ~w.isin(*pack.stopwords))


def exploded_keywords(df: DataFrame, keep: Sequence[str], name: str, pack: RulePack = ZH) -> DataFrame:
    """A row for each of ``keyword_tokens``, taken apart first: rules of rows are compiled, those inside arrays are not."""
    rows = df.select(*keep, F.explode(tokens("text", pack)).alias(name))
    return rows.withColumn(name, F.lower(name)).filter(F.col(name).isNotNull() & ~F.col(name).isin(*pack.stopwords))


# --- keywords -----------------------------------------------------------------------------------

def _graph_rank(words: list[str], window: int, iterations: int, k: int, damping: float, skip: frozenset[str]) -> list[tuple[str, float]]:
    """Best words of one text; ``skip`` words keep their places but have no edges."""
    numbers: dict[str, int] = {}
    at = np.array([-1 if w in skip else numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    ends = [(at[:-d], at[d:]) for d in range(1, window) if len(at) > d]
    if not ends:
        return []
    a, b = (np.concatenate(x) for x in zip(*ends))
    both = (a >= 0) & (b >= 0)
    a, b = a[both], b[both]
    if not len(a):
        return []
    source, into = np.concatenate([a, b]), np.concatenate([b, a])
    n = len(numbers)
    degree = np.bincount(source, minlength=n)
    linked = degree > 0
    share = 1.0 / degree[source]
    score = np.full(n, 1.0 / linked.sum())
    for _ in range(iterations):
        score = (1 - damping) + damping * np.bincount(into, share * score[source], n)
    names, score = np.array(list(numbers))[linked], score[linked]
    low, high = score.min(), score.max()
    score = (score - low / 10) / (high - low / 10)
    best = np.lexsort((names, -np.round(score, 9)))[:k]
    return list(zip(names[best].tolist(), score[best].tolist()))


def textrank(
    df: DataFrame, key: str | Sequence[str] = "doc_id", window: int = 5, iterations: int = 10, k: int = 10, damping: float = 0.85,
    pack: RulePack = ZH,
) -> DataFrame:
    """Top words of each text by weighted rank over its co-occurrence graph.

    The graph of a text is as large as the text, so each row is ranked where it lies, in
    Arrow batches of token arrays: no edges, no grouping, no shuffle. ``key`` is one row's, a column or several.
    """
    ship(df.sparkSession)
    skip = frozenset(pack.stopwords)
    keys = [key] if isinstance(key, str) else list(key)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def rank(batches):
        for batch in batches:
            ranked = [_graph_rank(w or [], window, iterations, k, damping, skip) for w in batch.column("_w").to_pylist()]
            sizes = [len(r) for r in ranked]
            rows = np.repeat(np.arange(len(ranked)), sizes)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array(rows)) for c in keys], pa.array([n for s in sizes for n in range(1, s + 1)], pa.int64()),
                pa.array([w for r in ranked for w, _ in r], pa.string()), pa.array([v for r in ranked for _, v in r], pa.float64()),
            ], names=[*keys, "rank", "keyword", "score"])

    words = df.select(*keys, F.transform(tokens("text", pack), F.lower).alias("_w"))
    return words.mapInArrow(rank, f"{kinds}, rank bigint, keyword string, score double")


#: most spread words whose numbers of texts go to every task
HEAD_TOKENS = 1 << 16


def tfidf_keywords(df: DataFrame, key: str = "doc_id", k: int = 10, pack: RulePack = ZH) -> DataFrame:
    """Top words by term count times ``ln((N + 1) / (df + 1))``.

    Texts are shuffled, not their words: a key's words are counted where its texts lie. The
    most spread words go to every task, and any other word is in one text at least and in no
    more than the last of those. So each word's score has bounds, and only words whose upper bound
    reaches a key's ``k``-th lower one meet their numbers of texts in a join. All of it is one
    plan, so the placed texts and the words' numbers of texts are shuffled once and read again.
    """
    total = df.select(key).distinct().agg(F.count(F.lit(1))).first()[0]
    placed = place_texts(df.select(key, "text"), key)
    tf = exploded_keywords(placed, [key], "token", pack).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    spread = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    frequent = spread.orderBy(F.desc("df"), "token").limit(HEAD_TOKENS)
    least = frequent.agg(F.coalesce(F.min("df"), F.lit(1)).alias("_least"))

    def score(texts: Column) -> Column:
        return F.col("tf") * F.log((F.lit(total) + 1) / (texts + 1))

    known = tf.join(F.broadcast(frequent), "token", "left").crossJoin(F.broadcast(least))
    bounds = known.withColumn("_low", score(F.coalesce("df", "_least"))).withColumn("_high", score(F.coalesce("df", F.lit(1)))).drop("df", "_least")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_low")))
    reached = F.max(F.when(F.col("_place") == k, F.col("_low"))).over(Window.partitionBy(key))
    few = bounds.withColumn("_place", place).withColumn("_kth", reached).filter(F.col("_kth").isNull() | (F.col("_high") >= F.col("_kth") - 1e-6))
    scored = few.select(key, "token", "tf").join(spread, "token").withColumn("score", score(F.col("df")))
    best = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), "token")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def keyword_hits(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Which of the expected words a text has, their number and ratio."""
    found = hits(F.coalesce("text", F.lit("")), words)
    return df.withColumn("hits", found).withColumn("hit_count", F.size("hits").cast("bigint")).withColumn(
        "hit_ratio", F.round(F.col("hit_count") / max(len(words), 1), 3)
    )


# --- topics --------------------------------------------------------------------------------------

def keyword_topics(kw: DataFrame, key: Sequence[str], k: int = 5, size: int = 3) -> DataFrame:
    """Ranked keywords in groups of three: a topic is named by its best word."""
    group = F.floor((F.col("rank") - 1) / size)
    rows = kw.filter(F.col("rank") <= k * size).withColumn("topic", group)
    return rows.groupBy(*key, "topic").agg(
        F.min_by("token", "rank").alias("name"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda r: r["token"]).alias("keywords"),
        F.round(F.avg("score"), 4).alias("score"),
    )


def name_topics(keywords: DataFrame, texts: DataFrame, topic: str = "topic", pack: RulePack = ZH) -> DataFrame:
    """A topic's best keyword, else its most common token, else a numbered name; only texts of topics that have no keyword are taken apart."""
    # written down, so that what joins it does not reach into the keywords' plan
    best = durable(keywords.groupBy(topic).agg(F.max_by("keyword", F.struct("score", "keyword")).alias("_k")))
    named = durable(texts.select(topic).distinct().join(best, topic, "left"))
    number = F.concat(F.lit("主题_"), F.col(topic).cast("string"))
    left = named.filter(F.col("_k").isNull() & F.col(topic).isNotNull()).select(topic)
    if left.isEmpty():
        return named.select(topic, F.coalesce("_k", number).alias("name"))
    rows = place_texts(texts.select(topic, "text").join(left, topic, "left_semi"))
    long = exploded_keywords(rows, [topic], "_t", pack).filter(F.length("_t") > 1)
    counts = long.groupBy(topic, "_t").agg(F.count(F.lit(1)).alias("_n"))
    common = counts.groupBy(topic).agg(F.min_by("_t", F.struct((-F.col("_n")).alias("n"), "_t")).alias("_c"))
    return named.join(common, topic, "left").select(topic, F.coalesce("_k", "_c", number).alias("name"))


def representatives(sents: DataFrame, topics: DataFrame, key: Sequence[str], n: int = 3) -> DataFrame:
    """The sentences of a key that contain most of a topic's keywords, per topic.

    ``topics`` has few rows per key; they meet each sentence as one array per key.
    """
    per_key = topics.groupBy(*key).agg(F.collect_list(F.struct("topic", "keywords")).alias("_t"))
    rows = sents.join(per_key, list(key)).select(*key, "pos", "sentence", F.explode("_t").alias("_t")).select(*key, "pos", "sentence", "_t.*")
    share = F.size(F.filter("keywords", lambda w: F.contains(F.col("sentence"), w))) / F.size("keywords")
    best = Window.partitionBy(*key, "topic").orderBy(F.col("relevance").desc(), "pos")
    scored = rows.withColumn("relevance", share).filter(F.col("relevance") > 0)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def topic_evolution(keywords: DataFrame, period: str, within: Sequence[str] = (), top: int = 5) -> DataFrame:
    """New, gone and kept keywords of each period against the one before.

    Words meet by join, so a period may have any number of them; only the first ``top`` of
    each kind come together.
    """
    over = Window.partitionBy(*within).orderBy("to_period")
    steps = keywords.select(*within, F.col(period).alias("to_period")).distinct()
    steps = steps.withColumn("from_period", F.lag("to_period").over(over)).filter(F.col("from_period").isNotNull())
    words = keywords.select(*within, F.col(period).alias("_period"), "token").distinct()
    at = [*within, "from_period", "to_period"]

    def of(side: str, mark: str) -> DataFrame:
        return steps.join(words.withColumnRenamed("_period", side), [*within, side]).select(*at, "token", F.lit(True).alias(mark))

    both = of("to_period", "_now").join(of("from_period", "_was"), [*at, "token"], "full")
    kind = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "gone").otherwise("kept")
    first = Window.partitionBy(*at, "_kind").orderBy("token")
    few = both.withColumn("_kind", kind).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= top)
    lists = few.groupBy(*at).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.col("token")))).alias(n)
        for k, n in (("new", "new_topics"), ("gone", "disappeared_topics"), ("kept", "persistent_topics"))
    ])
    return steps.select(*at).join(lists, at, "left")


#: rows of a key that are looked at first
EARLY_ROWS = 32


def sanitize_topics(df: DataFrame, key: Sequence[str], n: int = 5, pack: RulePack = ZH) -> DataFrame:
    """Topic rows ``(pos, name, keywords)``: valid names once each (case aside), keywords cleaned, first ``n``."""
    def once(words: Column) -> Column:
        clean = F.filter(F.transform(words, strip), lambda w: (w != "") & is_valid_topic(w, pack))
        firsts = F.filter(clean, lambda w, i: F.array_position(F.transform(clean, F.lower), F.lower(w)) == i + 1)
        return F.slice(firsts, 1, 6)

    def firsts(rows: DataFrame) -> DataFrame:
        # exact names once, then the rules, then names that differ in case only
        exact = rows.withColumn("name", strip("name")).groupBy(*key, "name").agg(F.min(F.struct("pos", "keywords")).alias("_t"))
        valid = exact.filter(is_valid_topic("name", pack)).select(*key, "name", "_t.*")
        first = valid.groupBy(*key, F.lower("name").alias("_k")).agg(F.min(F.struct("pos", "name", "keywords")).alias("_t")).select(*key, "_t.*")
        return first.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).filter(F.col("rank") <= n)

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys.select(*[F.col(c).alias(f"_{c}") for c in key]), same_key(key), how)

    # most keys have their names among their first rows; only the others' later rows are shuffled
    early = F.col("pos").isNull() | (F.col("pos") < EARLY_ROWS)
    found = durable(firsts(df.filter(early)))
    full = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    left = durable(among(df.filter(~early).select(*key).distinct(), full, "left_anti"))
    if not left.isEmpty():
        found = among(found, left, "left_anti").unionByName(firsts(among(df, left, "left_semi")))
    return found.select(*key, "rank", "name", once(F.col("keywords")).alias("keywords"))


def topic_series(topics: DataFrame) -> DataFrame:
    """Chart rows of topics: joined keywords, number of participants, bubble size."""
    return topics.select(
        *[c for c in topics.columns if c not in ("keywords", "speaker_involved")],
        F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ").alias("keywords"),
        F.coalesce(F.size("speaker_involved"), F.lit(0)).cast("bigint").alias("participants"),
        (F.col("confidence") * 50).alias("size"),
    )


def merge_labels(first, second) -> Column:
    """Two label lists as one: blanks out, each once, first place kept."""
    both = F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(both, strip), lambda v: v.isNotNull() & (v != "")))


def text_topics(df: DataFrame, key: Sequence[str], n: int = 5, pack: RulePack = ZH) -> DataFrame:
    """Frequent valid tokens of a text as topics."""
    return top_tokens(
        df, key, n, pack, "topic", stop=pack.topic_stop, lower_stop=pack.topic_stop_lower,
        only_valid=lambda w: is_valid_topic(w, pack),
    )


def resolve_topics(keys: DataFrame, key: Sequence[str], candidates: Sequence[DataFrame]) -> DataFrame:
    """The first candidate with topics for each key; candidates are rows ``(key, rank, name)``."""
    out = keys.select(*key).distinct()
    names = []
    for i, c in enumerate(candidates):
        listed = c.groupBy(*key).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias(f"_c{i}")
        )
        out = out.join(listed, list(key), "left")
        names.append(F.when(F.size(f"_c{i}") > 0, F.struct(F.lit(i).alias("source"), F.col(f"_c{i}").alias("topics"))))
    return out.withColumn("_r", F.coalesce(*names)).select(*key, F.col("_r.source").alias("source"), F.col("_r.topics").alias("topics"))


def as_topics(words: DataFrame, key: Sequence[str], name: str = "token") -> DataFrame:
    """Ranked words as topic rows ``(pos, name, keywords)``, each its own keyword."""
    return words.select(*key, F.col("rank").cast("int").alias("pos"), F.col(name).alias("name"), F.array(name).alias("keywords"))


def analysed_topics(texts: DataFrame, key: str, n: int = 5, pack: RulePack = ZH) -> DataFrame:
    """Topic rows ``(pos, name, keywords)`` of one text per key: its words by graph rank in groups of three."""
    ranked = textrank(texts, key, k=3 * n, pack=pack).withColumnRenamed("keyword", "token")
    return keyword_topics(ranked, [key], n).select(key, F.col("topic").cast("int").alias("pos"), "name", "keywords")


def cascade_topics(keys: DataFrame, key: Sequence[str], levels: Sequence[tuple[Callable[[DataFrame], DataFrame], bool]], n: int = 5, pack: RulePack = ZH) -> DataFrame:
    """Topics of each key from the first level that has some, with the level's number.

    A level is a function from the keys that are left to topic rows ``(*key, pos, name, keywords)``
    and whether they are sanitized; others are taken as they are, the first ``n`` of them. A level
    only ever sees the keys without topics so far, so a costly one runs on few. Keys that
    no level helps have a null source and null topics.
    """
    left = durable(keys.select(*key).distinct())
    out: DataFrame | None = None
    for i, (level, sanitized) in enumerate(levels):
        rows = level(left)
        if sanitized:
            rows = sanitize_topics(rows, key, n, pack)
        else:
            first = Window.partitionBy(*key).orderBy("pos")
            rows = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
        found = durable(rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "keywords"))).alias("topics")))
        left = durable(left.join(found.select(*key), list(key), "left_anti"))
        told = found.select(*key, F.lit(i).alias("source"), "topics")
        out = told if out is None else out.unionByName(told)
        if left.isEmpty():
            break
    return left.unionByName(out, allowMissingColumns=True) if out is not None else left


# --- models ----------------------------------------------------------------------------------------

def _counted(df: DataFrame, key: Sequence[str], size: int, pack: RulePack):
    words = df.select(*key, keyword_tokens("text", pack).alias("_words"))
    model = CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=size).fit(words)
    # the models read the counts once per round: write them down instead of splitting the texts again
    return model, durable(model.transform(words).drop("_words"))


def lda_topics(df: DataFrame, k: int = 5, vocabulary: int = 1000, pack: RulePack = ZH) -> DataFrame:
    """Five best words of each latent topic with their weights."""
    model, counted = _counted(df, [], vocabulary, pack)
    lda = LDA(k=k, maxIter=10, seed=42, featuresCol="_tf").fit(counted)
    words = F.array(*[F.lit(w) for w in model.vocabulary])
    best = lda.describeTopics(5).select(
        F.col("topic").cast("bigint").alias("topic"),
        F.posexplode(F.arrays_zip(F.col("termIndices").alias("i"), F.col("termWeights").alias("w"))).alias("rank", "_t"),
    )
    return best.select("topic", (F.col("rank") + 1).cast("bigint").alias("rank"), F.get(words, F.col("_t.i")).alias("keyword"), F.col("_t.w").alias("weight"))


def cluster_documents(df: DataFrame, k: int = 5, key: str = "doc_id", pack: RulePack = ZH) -> DataFrame:
    """TF-IDF clusters; a single document is cluster 0."""
    if df.select(key).limit(2).count() <= 1:
        return df.select(key, F.lit(0).cast("bigint").alias("cluster"))
    _, counted = _counted(df, [key], 100, pack)
    weighted = IDF(inputCol="_tf", outputCol="_w").fit(counted).transform(counted)
    unit = Normalizer(inputCol="_w", outputCol="features").transform(weighted)
    clusters = min(k, df.select(key).limit(k).count())
    out = KMeans(k=clusters, seed=42, featuresCol="features", predictionCol="_p").fit(unit).transform(unit)
    return out.select(key, F.col("_p").cast("bigint").alias("cluster"))

