"""The stage of near copies against brute force over five-word shingles at 0.8."""

import glob
import os
import random

import corpus_pipeline
import numpy as np
import pytest
import rows

from colloquy.llm import jaccard

PLANTED = 10_000


def planted(rng):
    """Pairs of texts with 5-word similarities around 0.8: edited in separated words, or in one run."""
    texts = []
    for k, spots in enumerate([(30, 70), (20, 60, 80), (50,), (40, 41, 42, 43), (40, 41, 42, 43, 44, 45), (10, 30, 50, 70, 90), (99,), (0, 99)] * 3):
        words = [f"p{k}x{rng.randrange(10**6)}" for _ in range(100)]
        other = [f"new{j}" if j in spots else x for j, x in enumerate(words)]
        texts += [" ".join(words), " ".join(other)]
    # a chain: neighbours are near copies, its ends are not
    words = [f"chain{j}" for j in range(100)]
    for k in range(4):
        texts.append(" ".join(f"link{k}y{j}" if j in (20 * k + 5, 20 * k + 15) and k else x for j, x in enumerate(words)))
    return texts


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[j: j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def least_of_groups(texts, size, share):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in texts}


def test_near_copies_are_grouped_by_five_words(spark):
    texts = {PLANTED + k: t for k, t in enumerate(planted(random.Random(4)))}
    texts |= {k: rows.prose(k, 20 + 7 * k) for k in range(20)} | {100: "one two three", 101: "One two three", 102: "", 103: None, 104: "one two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near copies"]
    kept = sorted(x.doc_id for x in stage(spark, docs, "").collect())
    expected = least_of_groups(texts, 5, 80)
    assert kept == sorted(expected)
    # some pairs are near copies by five words at 0.8, but not by three at 0.9
    assert expected < least_of_groups(texts, 3, 90)


def with_phrases(rng, documents=300):
    """Texts of private words and of phrases that many texts have, each fifth of them with a near copy, and how many have one."""
    phrases = [" ".join(f"f{k}w{j}" for j in range(5)) for k in range(20)]
    texts = []
    for k in range(documents):
        parts = [f"d{k}w{j}" for j in range(60)] + rng.sample(phrases, 8)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
        if k % 5 == 0:
            texts.append(texts[-1] + f" d{k}end")
    return texts


@pytest.mark.parametrize(("size", "threshold"), [(3, (90, 100)), (5, (80, 100))])
def test_shared_phrases_make_no_family(spark, monkeypatch, size, threshold):
    # two buckets, as full as those of a large corpus, and lists that are long from three classes on
    for name, value in {"LIST_PAIRS": 2, "LIST_CLASSES": 16, "TIE_SETS": 8}.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = with_phrases(random.Random(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = jaccard.link_documents(docs, size, threshold, 1).collect()
    assert {x.doc_id for x in found if x.doc_id == x.component_id} == least_of_groups(dict(enumerate(texts)), size, threshold[0])
    assert sum(x.n_links for x in found) == 2 * 60
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).removeprefix("file:")
    members = spark.read.parquet(max(glob.glob(f"{base}/jaccard-members-*"), key=os.path.getmtime))
    assert max(x["count"] for x in members.groupBy("family").count().collect()) <= 4


def test_shingles_of_seldom_words_come_first_where_buckets_are_full():
    bits = 8
    shingles = np.full(1 << bits, 1000)
    words = np.where(np.arange(1 << bits) < 128, 4000, 2)
    weigh = jaccard.likely_counts(shingles, words, 3)
    often = np.arange(6, dtype=np.uint64) << np.uint64(64 - bits)
    seldom = often + np.uint64(1 << 63)
    hashes = np.arange(2, dtype=np.uint64)
    a, b = weigh(hashes, np.concatenate([often[:3], seldom[:3]]), np.array([0, 3]))
    assert a > b
    # what its bucket holds beyond the usual makes a shingle frequent, but not more than its words
    shingles[128] = 2000
    weigh = jaccard.likely_counts(shingles, np.full(1 << bits, 500), 3)
    full, usual = weigh(np.array([1 << 63, 1], np.uint64), often, np.array([0, 3]))
    assert full > usual and full >> 32 == 8
