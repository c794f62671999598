"""Language identification by the nearest of several clustered centroids per language.

A text is its lower-cased letters with one space for all else; its vector counts the
byte n-grams in hashed slots, weighed by logarithm and by inverse document frequency,
of length one. Each language's texts form clusters, a centroid each. The language of
the centroid with the largest cosine is the answer; a text farther from it than nearly
all texts it was made of is marked as rejected.

Document frequencies, centroids and distances are sums over all learning texts, in
whole numbers, so their order does not matter; only the seeds of the clusters come from
a bounded sample of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.support import byte_column, slabs, vector_sum

SLOTS = 1 << 13
LONGEST = 4
CLUSTERS = 3
#: labelled texts per language that seed its clusters
SEEDS = 256
#: share of a centroid's own texts that lie farther away than its limit
FAR = 0.005
BINS = 512
UNIT = 1 << 24
CHUNK_ROWS, CHUNK_BYTES = 64, 1 << 18
UNKNOWN = "und"
FIELDS = "lang: string, score: double, distance: double, cluster: int, rejected: boolean"


def letters(text: Column) -> Column:
    """Lower-cased letters with single spaces around and between words; null where there is no letter."""
    spaced = F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")))
    return F.when(F.regexp_like(text, F.lit(r"\p{L}")), F.concat(F.lit(" "), spaced, F.lit(" ")))


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in slabs(batches, column, CHUNK_BYTES):
        for begin in range(0, batch.num_rows, CHUNK_ROWS):
            yield batch.slice(begin, CHUNK_ROWS)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often n-grams of 1 to LONGEST bytes fall in each slot, a row per text."""
    rows, n = len(offsets) - 1, len(data)
    row_of = np.repeat(np.arange(rows, dtype=np.int64) * SLOTS, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the end of the text
    counts = np.zeros(rows * SLOTS, np.int64)
    code = np.zeros(n, np.uint32)
    for size in range(1, LONGEST + 1):
        if n < size:
            break
        code = (code[: n - size + 1] << np.uint32(8)) | data[size - 1:]
        slot = (code * np.uint32(0x9E3779B1) ^ np.uint32(0x85EBCA6B * size & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - SLOTS.bit_length() + 1)
        inside = left[: n - size + 1] >= size
        counts += np.bincount((row_of[: n - size + 1] + slot)[inside], minlength=len(counts))
    return counts.reshape(rows, SLOTS)


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of normalised texts; zero for texts without n-grams."""
    counts = gram_counts(*byte_column(column))
    out = np.zeros(counts.shape)
    row, slot = np.nonzero(counts)
    value = np.log1p(counts[row, slot]) * idf[slot]
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(counts)))
    out[row, slot] = value / np.maximum(norm, 1e-300)[row]
    return out


@dataclass
class Model:
    """Languages in order, and per centroid its language's number, direction and least cosine."""

    langs: list[str]
    idf: np.ndarray
    owner: np.ndarray
    centres: np.ndarray
    least: np.ndarray


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def spherical_clusters(x: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors; the first is next to the mean, each further one is the vector least like those before."""
    picked = [int((x @ x.mean(axis=0)).argmax())]
    while len(picked) < clusters:
        near = (x @ x[picked].T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        picked.append(int(near.argmin()))
    centres = x[picked]
    for _ in range(rounds):
        mine = (x @ centres.T).argmax(axis=1)
        centres = _units(np.stack([x[mine == k].sum(axis=0) for k in range(len(centres)) if (mine == k).any()]))
    return centres


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, clusters: int = CLUSTERS, seeds: int = SEEDS) -> Model:
    """Learn from the rows with a language and a letter.

    Frequencies, centroids and limits are over all of them. At most ``seeds`` texts of
    each language, those with the smallest ``order``, seed its clusters; ``order`` is a
    64-bit hash that spreads the rows (by default that of the text), so a first cut by
    its value keeps about as many as are needed before anything is shuffled. Without
    such rows there are no languages.
    """
    order = F.xxhash64(text) if order is None else order
    rows = docs.select(F.col(lang).alias("lang"), letters(F.col(text)).alias("text"), order.alias("turn")).where("lang is not null and text is not null")
    known = rows.select("lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in chunks(batches, "text"):
            total[:-1] += (gram_counts(*byte_column(batch.column("text"))) > 0).sum(axis=0)
            total[-1] += batch.num_rows
        return total

    found = vector_sum(known, frequencies, SLOTS + 1, "<i8")
    idf = np.log((found[-1] + 1) / (found[:-1] + 1)) + 1
    sizes = docs.select(F.col(lang).alias("lang")).where("lang is not null").groupBy("lang").count()
    share = F.lit(2.0 * seeds + 64) / F.col("count")
    # a row per language, as many as the model holds
    few = rows.join(F.broadcast(sizes), "lang").where(F.col("turn").cast("double") / 2.0**64 + 0.5 <= share).drop("count")
    best = Window.partitionBy("lang").orderBy("turn", "text")
    sample = few.withColumn("place", F.row_number().over(best)).where(F.col("place") <= seeds)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            units = [x.tobytes() for x in vectors(batch.column("text"), idf)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(units, pa.binary())], names=["lang", "place", "vector"])

    def seed(part: pd.DataFrame) -> pd.DataFrame:
        centres = spherical_clusters(np.stack([np.frombuffer(x) for x in part.sort_values("place")["vector"]]), clusters)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "cluster": range(len(centres)), "centre": [x.tobytes() for x in centres]})

    sampled = sample.select("lang", "place", "text").mapInArrow(turned, "lang string, place int, vector binary")
    seeded = sampled.groupBy("lang").applyInPandas(seed, "lang string, cluster int, centre binary").collect()
    seeded.sort(key=lambda x: (x.lang, x.cluster))
    langs = sorted({x.lang for x in seeded})
    owner = np.array([langs.index(x.lang) for x in seeded], np.int64)
    if not langs:
        return Model([], idf, owner, np.zeros((0, SLOTS)), np.zeros(0))
    centres = np.stack([np.frombuffer(x.centre) for x in seeded])
    return _refine(known, Model(langs, idf, owner, centres, np.zeros(len(owner))))


def _refine(known: DataFrame, model: Model) -> Model:
    """Centroids and limits from all learning texts: each joins the nearest seed of its own language."""
    shared = known.sparkSession.sparkContext.broadcast(model)
    n = len(model.owner)

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        model = shared.value
        number = {x: k for k, x in enumerate(model.langs)}
        total = np.zeros((n, SLOTS + BINS), np.int64)
        for batch in chunks(batches, "text"):
            x = vectors(batch.column("text"), model.idf)
            own = np.array([number[k] for k in batch.column("lang").to_pylist()])
            cosine = np.where(model.owner[None, :] == own[:, None], x @ model.centres.T, -1.0)
            mine, near = cosine.argmax(axis=1), cosine.max(axis=1)
            for k in np.unique(mine):
                total[k, :SLOTS] += np.rint(x[mine == k] * UNIT).astype(np.int64).sum(axis=0)
            np.add.at(total, (mine, SLOTS + np.clip((near * BINS).astype(np.int64), 0, BINS - 1)), 1)
        return total.ravel()

    total = vector_sum(known, fold, n * (SLOTS + BINS), "<i8").reshape(n, -1)
    used = np.flatnonzero(total[:, SLOTS:].sum(axis=1))
    below = total[used, SLOTS:].cumsum(axis=1)
    least = (below <= FAR * below[:, -1:]).sum(axis=1) / BINS
    return Model(model.langs, model.idf, model.owner[used], _units(total[used, :SLOTS].astype(float)), least)


def identify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, Column]:
    """The rows of ``docs`` with one more column, and that column: a struct of lang, score, distance, cluster, rejected.

    ``lang`` is the language of the nearest centroid (of equally near ones the first by
    name), ``score`` its cosine from 0 to 1, ``distance`` the rest to 1; ``rejected``
    tells that the text is farther away than all but FAR of the centroid's own learning
    texts. Null text, text without a letter, and any text where nothing was learned has
    language ``und``, score 0, distance 1 and is rejected. Repeated rows are judged
    each, an empty table gives no rows, other columns pass through whatever their names
    and are not looked at.
    """
    state, plain = "language", "letters"
    while state in docs.columns:
        state = f"_{state}"
    while plain in docs.columns:
        plain = f"_{plain}"
    out = docs.withColumn(state, F.lit(None).cast(f"struct<{FIELDS}>"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    none = {"lang": UNKNOWN, "score": 0.0, "distance": 1.0, "cluster": None, "rejected": True}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, plain):
            at = batch.schema.get_field_index(plain)
            column, batch = batch.column(at), batch.remove_column(at)
            found = [none] * batch.num_rows
            if len(model.owner):
                cosine = vectors(column, model.idf) @ model.centres.T
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(best)), best], 0, 1).round(9)
                there = column.is_valid().to_pylist()
                for row, (k, near) in enumerate(zip(best.tolist(), score.tolist())):
                    if there[row]:
                        first = int(np.searchsorted(model.owner, model.owner[k]))
                        found[row] = {
                            "lang": model.langs[model.owner[k]], "score": near, "distance": 1 - near, "cluster": k - first, "rejected": near < model.least[k],
                        }
            at = batch.schema.get_field_index(state)
            kind = batch.schema.field(at)
            yield batch.set_column(at, kind, pa.array(found, kind.type))

    return out.withColumn(plain, letters(F.col(text))).mapInArrow(run, out.schema), F.col(state)
