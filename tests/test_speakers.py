"""Speaker matching: worked-out cases, and what must hold for any input."""

import math
import random
from collections import Counter

import pytest
from colloquy.operators import speakers as sp

SCHEMA = "meeting_id long, chunk_id long, local_speaker long, vec array<double>"
PAIRS = "meeting_id long, chunk_id long, speaker long, previous long, similarity double"


@pytest.fixture(scope="module")
def features(spark):
    rnd = random.Random(11)
    voices = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = []
    for m in range(6):
        for c in range(13):
            if m == 3 and c == 5:
                continue
            for s in rnd.sample(range(5), rnd.randrange(1, 5)):
                out.append((m, c, s, [v + rnd.gauss(0, 0.35) for v in voices[(s + c) % 5]]))
    out.append((0, 13, 0, [0.0] * 6))
    return spark.createDataFrame(out, SCHEMA).cache()


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-3.0, 0.0]), ([1.0, 0.0], [0.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.s for r in df.select(sp.cosine01("a", "b").alias("s")).collect()] == [1.0, 0.0, 0.5, 0.0]


def test_second_choice(spark):
    """The literal matrices: greedy gives a second choice, the other variant a new id."""
    pairs = [(0, 1, 0, 0, .9), (0, 1, 0, 1, .8), (0, 1, 1, 0, .95), (0, 1, 1, 1, .75)]
    df = spark.createDataFrame(pairs, PAIRS)
    assert {(r.speaker, r.previous) for r in sp.greedy_matches(df, .7).collect()} == {(1, 0), (0, 1)}
    assert {(r.speaker, r.previous) for r in sp.best_candidates(df, .7).collect()} == {(0, 0), (1, None)}
    low = spark.createDataFrame([(0, 1, 0, 0, .9), (0, 1, 0, 1, .8), (0, 1, 1, 0, .85), (0, 1, 1, 1, .2)], PAIRS)
    assert {(r.speaker, r.previous) for r in sp.greedy_matches(low, .7).collect()} == {(0, 0)}


def test_no_better_pair_is_left(features):
    pairs = sp.pair_similarity(features)
    every = {(r.meeting_id, r.chunk_id, r.speaker, r.previous): r.similarity for r in pairs.collect()}
    chosen = {(r.meeting_id, r.chunk_id, r.speaker, r.previous) for r in sp.greedy_matches(pairs, 0.7).collect()}
    assert chosen and chosen <= set(every)
    of, to = {k[:3]: k for k in chosen}, {(k[0], k[1], k[3]): k for k in chosen}
    assert len(of) == len(to) == len(chosen)
    for k, s in every.items():
        if k in chosen:
            assert s >= 0.7
        elif s >= 0.7:
            # one of its two sides went to a pair at least as similar
            rivals = [x for x in (of.get(k[:3]), to.get((k[0], k[1], k[3]))) if x]
            assert rivals and max(every[x] for x in rivals) >= s


@pytest.mark.parametrize("variant,form,limit", [("greedy", "SPK_%03d", 0.7), ("best", "SPEAKER_%02d", 0.6)])
def test_tracks(features, variant, form, limit):
    tracks = {(r.meeting_id, r.chunk_id, r.speaker): r.global_speaker for r in sp.track_speakers(features, limit, variant).collect()}
    assert len(tracks) == features.count()
    # an id is used once in a chunk, and the ids of a meeting are numbered in the order they turn up
    assert max(Counter((m, c, g) for (m, c, _), g in tracks.items()).values()) == 1
    for m in range(6):
        seen = list(dict.fromkeys(g for (n, _, _), g in sorted(tracks.items()) if n == m))
        assert seen == [form % k for k in range(len(seen))]
    if variant == "greedy":
        linked = {(r.meeting_id, r.chunk_id, r.speaker): r.previous for r in sp.greedy_matches(sp.pair_similarity(features), limit).collect()}
        for (m, c, s), g in tracks.items():
            if (m, c, s) in linked:
                assert g == tracks[m, c - 1, linked[m, c, s]]
            else:
                assert g not in {h for (n, d, _), h in tracks.items() if n == m and d < c}


def test_profiles(spark):
    """A voice that skips a chunk is known again, a profile follows its last five vectors, a second claimant is new."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0, 0, a), (1, 0, 1, b), (1, 1, 0, b), (1, 2, 0, a), (1, 2, 1, b), (1, 3, 0, a), (1, 3, 1, a)]
    got = {(r.chunk_id, r.speaker): r.global_speaker for r in sp.track_speakers(spark.createDataFrame(rows, SCHEMA), 0.7, "best").collect()}
    assert got == {
        (0, 0): "SPEAKER_00", (0, 1): "SPEAKER_01", (1, 0): "SPEAKER_01", (2, 0): "SPEAKER_00", (2, 1): "SPEAKER_01", (3, 0): "SPEAKER_00", (3, 1): "SPEAKER_02",
    }
    # the mean of the last five turns, of which the first is forgotten
    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    drift = [(1, k, 0, turn(12 * k)) for k in range(9)] + [(2, 0, 0, a), (2, 1, 0, turn(61))]
    got = {(r.meeting_id, r.chunk_id): r.global_speaker for r in sp.track_speakers(spark.createDataFrame(drift, SCHEMA), 0.88, "best").collect()}
    assert {got[1, k] for k in range(9)} == {"SPEAKER_00"} and got[2, 1] == "SPEAKER_01"


def test_literal_track(spark):
    """Two voices swap their local numbers; a third one comes, and a gap in the chunks ends all tracks."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, 0, 0, a), (1, 0, 1, b), (1, 1, 0, b), (1, 1, 1, a), (1, 2, 0, c), (1, 2, 1, b), (1, 4, 0, b)]
    got = {(r.chunk_id, r.speaker): r.global_speaker for r in sp.track_speakers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, 0): "SPK_000", (0, 1): "SPK_001", (1, 0): "SPK_001", (1, 1): "SPK_000", (2, 0): "SPK_002", (2, 1): "SPK_001", (4, 0): "SPK_003"}
