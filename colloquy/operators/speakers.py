"""Speaker identity across chunks: similarity, one-to-one matching, profiles.

Input: ``(meeting_id, chunk_id, local_speaker, vec)`` with ``vec array<double>``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.plans.hot import durable, number_rows


def cosine01(a, b) -> Column:
    """(cosine + 1) / 2; 0 when either vector has no length."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, (dot(a, b) / norm + 1) / 2).otherwise(F.lit(0.0))


def pair_similarity(features: DataFrame) -> DataFrame:
    """Speakers of a chunk against those of the chunk before, in the same meeting."""
    cur = features.select("meeting_id", "chunk_id", F.col("local_speaker").alias("speaker"), F.col("vec").alias("_v"))
    prev = features.select(
        "meeting_id", (F.col("chunk_id") + 1).alias("chunk_id"), F.col("local_speaker").alias("previous"), F.col("vec").alias("_u")
    )
    return cur.join(prev, ["meeting_id", "chunk_id"]).select("meeting_id", "chunk_id", "speaker", "previous", cosine01("_v", "_u").alias("similarity"))


def best_candidates(pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per speaker the most similar previous one; the first speaker to claim it keeps it.

    A later claimant gets no second choice: its ``previous`` is null, a new speaker.
    """
    top = pairs.filter(F.col("similarity") >= threshold).groupBy("meeting_id", "chunk_id", "speaker").agg(
        F.max_by("previous", F.struct("similarity", (-F.col("previous")).alias("t"))).alias("_p"), F.max("similarity").alias("similarity")
    )
    claim = F.row_number().over(Window.partitionBy("meeting_id", "chunk_id", "_p").orderBy("speaker"))
    claimed = top.withColumn("_claim", claim).withColumn("previous", F.when(F.col("_claim") == 1, F.col("_p")))
    everyone = pairs.select("meeting_id", "chunk_id", "speaker").distinct()
    return everyone.join(claimed.select("meeting_id", "chunk_id", "speaker", "previous", "similarity"), ["meeting_id", "chunk_id", "speaker"], "left")


def greedy_matches(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One-to-one matches within each chunk, best pair first; ties by speaker, then previous.

    A group is the pairs of one chunk, so it stays as small as the cast of that chunk.
    """
    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "speaker", "previous"], ascending=[False, True, True])
        taken, used, rows = set(), set(), []
        for at, p in enumerate(pdf.itertuples()):
            if p.speaker not in taken and p.previous not in used:
                taken.add(p.speaker)
                used.add(p.previous)
                rows.append(at)
        return pdf.iloc[rows]

    close = pairs.filter(F.col("similarity") >= threshold)
    return close.groupBy("meeting_id", "chunk_id").applyInPandas(match, pairs.schema)


def mean_vector(vectors) -> Column:
    """Value-by-value mean of an array of vectors."""
    vectors = F.col(vectors) if isinstance(vectors, str) else vectors
    total = F.aggregate(F.slice(vectors, 2, F.size(vectors)), vectors[0], lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    return F.transform(total, lambda v: v / F.size(vectors))


class ProfileTable:
    """The speakers of one meeting: each one's last vectors, by number."""

    def __init__(self, threshold: float, memory: int):
        self.threshold, self.memory, self.recent = threshold, memory, []

    def hear(self, vectors: list) -> list[int]:
        """Numbers of a chunk's speakers, in their order; then their vectors join the profiles."""
        best, known = [-1] * len(vectors), len(self.recent)
        if known and vectors:
            means = np.array([np.mean(v, axis=0) for v in self.recent])
            heard = np.array(vectors)
            norms = np.sqrt((heard * heard).sum(axis=1))[:, None] * np.sqrt((means * means).sum(axis=1))[None, :]
            alike = np.divide(heard @ means.T, norms, out=np.full(norms.shape, -1.0), where=norms > 0) / 2 + 0.5
            for at, row in enumerate(np.where(norms > 0, alike, 0.0)):
                top = int(row.argmax())
                # the first one to claim a profile keeps it
                if row[top] >= self.threshold and row[top] > 0 and top not in best:
                    best[at] = top
        out = []
        for number, vector in zip(best, vectors):
            if number < 0:
                number = len(self.recent)
                self.recent.append([])
            self.recent[number] = [*self.recent[number], vector][-self.memory:]
            out.append(number)
        return out


def track_profiles(features: DataFrame, threshold: float = 0.6, memory: int = 5) -> DataFrame:
    """Global ids by profiles: the mean of the last ``memory`` vectors of every speaker known in the meeting.

    A speaker takes the most similar profile at or above the threshold, the first one to
    claim it keeps it, others are new; whoever skips chunks is known again. A profile
    depends on all chunks before it, so a meeting is gone through in order: rows are
    placed by meeting and sorted by chunk, and pass by one chunk at a time with a table of
    the meeting's profiles. That table, as large as the cast, is all a task holds.
    """
    def run(batches):
        meeting, chunk, waiting, table = None, None, [], ProfileTable(threshold, memory)

        def told():
            numbers = table.hear([v for _, v in waiting])
            return [(meeting, chunk, s, f"SPEAKER_{n:02d}") for (s, _), n in zip(waiting, numbers)]

        for rows in batches:
            out = []
            for m, c, s, v in rows.itertuples(index=False, name=None):
                if (m, c) != (meeting, chunk):
                    out += told()
                    waiting = []
                    if m != meeting:
                        table = ProfileTable(threshold, memory)
                    meeting, chunk = m, c
                waiting.append((s, np.asarray(v, float)))
            if out:
                yield pd.DataFrame(out, columns=names)
        if waiting:
            yield pd.DataFrame(told(), columns=names)

    rows = features.select("meeting_id", "chunk_id", F.col("local_speaker").alias("speaker"), "vec")
    placed = rows.repartition("meeting_id").sortWithinPartitions("meeting_id", "chunk_id", "speaker")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["meeting_id", "chunk_id", "speaker", "global_speaker"]
    return placed.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names[:3]) + ", global_speaker string")


def track_speakers(features: DataFrame, threshold: float = 0.7, variant: str = "greedy") -> DataFrame:
    """A global speaker id for every (chunk, local speaker) of a meeting.

    ``best`` matches against profiles, see ``track_profiles``. With ``greedy`` a match links a speaker to one of the chunk before, so the links form chains and a
    speaker's id is that of its chain's first member. Chains are followed by doubling
    (each round reaches twice as far), which needs log2(chunks) joins and no task that
    sees a whole meeting. New ids are numbered by chunk, then local speaker.
    """
    if variant == "best":
        return track_profiles(features, threshold)
    if variant != "greedy":
        raise ValueError(f"unknown variant {variant}")
    links, form = greedy_matches(pair_similarity(features), threshold), "SPK_%03d"
    cast = features.select("meeting_id", "chunk_id", F.col("local_speaker").alias("speaker"))
    at = ["meeting_id", "chunk_id", "speaker"]
    known = cast.join(links.select(*at, "previous"), at, "left").select(
        *at, F.when(F.col("previous").isNull(), F.col("chunk_id")).otherwise(F.col("chunk_id") - 1).alias("root_chunk"),
        F.coalesce("previous", "speaker").alias("root_speaker"),
    )
    known = durable(known)
    span = known.agg(F.max("chunk_id") - F.min("chunk_id") + 1).first()[0] or 1
    for _ in range(max(1, int(span - 1).bit_length())):
        up = known.select(
            "meeting_id", F.col("chunk_id").alias("root_chunk"), F.col("speaker").alias("root_speaker"),
            F.col("root_chunk").alias("_c"), F.col("root_speaker").alias("_s"),
        )
        step = known.join(up, ["meeting_id", "root_chunk", "root_speaker"], "left")
        known = durable(step.select(*at, F.coalesce("_c", "root_chunk").alias("root_chunk"), F.coalesce("_s", "root_speaker").alias("root_speaker")))
    roots = known.filter((F.col("root_chunk") == F.col("chunk_id")) & (F.col("root_speaker") == F.col("speaker")))
    numbered = number_rows(roots.select(*at), ["meeting_id"], ["chunk_id", "speaker"], "number")
    ids = numbered.select("meeting_id", F.col("chunk_id").alias("root_chunk"), F.col("speaker").alias("root_speaker"), "number")
    return known.join(ids, ["meeting_id", "root_chunk", "root_speaker"]).select(
        *at, F.format_string(form, "number").alias("global_speaker")
    )


def rolling_profile(features: DataFrame, n: int = 5, speaker: str = "local_speaker") -> DataFrame:
    """Mean of a speaker's last ``n`` vectors up to each chunk, value by value."""
    last = Window.partitionBy("meeting_id", speaker, "dim").orderBy("chunk_id").rowsBetween(-(n - 1), 0)
    cells = features.select("meeting_id", speaker, "chunk_id", F.posexplode("vec").alias("dim", "value"))
    return cells.withColumn("value", F.avg("value").over(last))
