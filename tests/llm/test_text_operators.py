import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import cotraining, decontaminate, jaccard, language_model, licenses, line_labels, packing, token_counts
from colloquy.llm.tokens import codec

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return rows.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def spaced(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# tokens


def test_chunks_give_the_ids_of_the_library(texts, library):
    for _, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert codec(WORDS).encode([(text or "").encode()]) == [ids]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_to_the_library(texts, name):
    path = public_tokenizers.path(name)
    some = [t or "" for _, t in texts if t is None or len(t) < 5000][:20]
    found = [len(x) // 4 for x in codec(path).encode([t.encode() for t in some])]
    if name.endswith(".model"):
        import sentencepiece

        expected = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(some)]
    else:
        expected = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in some]
    assert found == expected


def test_token_counts_come_from_the_cache_the_second_time(spark, docs, texts, library, tmp_path):
    cache = str(tmp_path / "cache")
    expected = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    for _ in range(2):
        found = token_counts.token_counts(docs, WORDS, cache).collect()
        assert Counter((x.doc_id, x.n_bytes, x.n_tokens) for x in found) == expected
        # each distinct content once, and nothing new in the second run
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts})
    # stored counts are what the run returns
    digest = hashlib.sha256(b"never seen").hexdigest()
    one = spark.createDataFrame([(digest, token_counts.file_digest(WORDS), 77)], token_counts.CACHE)
    one.write.mode("append").parquet(cache)
    new = spark.createDataFrame([(1, "never seen")], "doc_id long, text string")
    assert token_counts.token_counts(new, WORDS, cache).first().n_tokens == 77
    assert token_counts.token_counts(rows.empty(spark), WORDS).count() == 0


# packing


def test_closest_fill_is_the_best_subset():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        items = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        capacity = int(rng.integers(1, 90))
        reach = {0}
        for x in items:
            reach |= {y + x for y in reach if y + x <= capacity}
        counts = packing.closest_fill(Counter(items), capacity)
        assert sum(k * v for k, v in counts.items()) == max(reach)
        assert all(v <= Counter(items)[k] for k, v in counts.items())
    assert packing.closest_fill({}, 5) == {} and packing.closest_fill({7: 2}, 5) == {}


@pytest.mark.parametrize("capacity", [64, 4096])
def test_every_id_is_in_one_piece(docs, texts, library, capacity):
    pieces = packing.pack_documents(docs, WORDS, capacity=capacity, pool=16).collect()
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    cut, windows = defaultdict(list), defaultdict(list)
    for x in pieces:
        cut[x.doc_id].append((x.start, bytes(x.ids), x.doc_tokens))
        windows[x.sequence_id].append((x.offset, x.length))
        assert len(x.ids) == 4 * x.length
    for i, whole in ids.items():
        if len(whole) == 1:
            parts = sorted(cut[i])
            assert b"".join(p for _, p, _ in parts) == whole[0] and {n for *_, n in parts} == {len(whole[0]) // 4}
            assert [s for s, *_ in parts] == [sum(len(p) for _, p, _ in parts[:k]) // 4 for k in range(len(parts))]
        else:
            assert sum(len(p) for _, p, _ in cut[i]) == sum(map(len, whole))
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == capacity or end < capacity and end & end - 1 == 0


def test_packing_nothing(spark):
    assert packing.pack_documents(rows.empty(spark), WORDS).count() == 0
    assert packing.pack_ids(spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")).count() == 0


# n-gram join


def shingles(text):
    w = [x.lower() for x in spaced(text)]
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)]) if w else frozenset()


@pytest.mark.parametrize(("pairs", "classes", "sets"), [(32, 1024, 2048), (2, 4, 2)])
def test_links_are_those_of_brute_force(docs, texts, monkeypatch, pairs, classes, sets):
    monkeypatch.setattr(jaccard, "LIST_PAIRS", pairs)
    monkeypatch.setattr(jaccard, "LIST_CLASSES", classes)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    found = jaccard.link_documents(docs).collect()
    all_rows = [(i, shingles(t)) for i, t in texts]
    root = list(range(len(all_rows)))
    degree = [0] * len(all_rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (i, x) in enumerate(all_rows):
        for b, (j, y) in enumerate(all_rows[:a]):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 90 * len(x | y):
                degree[a] += 1
                degree[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(all_rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    expected = Counter((i, len(s), least.get(find(k)), degree[k]) for k, (i, s) in enumerate(all_rows))
    assert Counter((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in found) == expected


def test_parities_bound_differences():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 4000, np.uint64)
    for n, m, common in ((10, 11, 9), (100, 104, 98), (1000, 940, 900), (3000, 2900, 100)):
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[-(m - common):]]))
        x, y = jaccard.parities(np.concatenate([a, b]), np.array([0, n, n + m]))
        assert jaccard.fewest_differences(x, y) <= n + m - 2 * common
        assert jaccard.fewest_differences(x, x) == 0


def test_one_document_of_each_group_stays(spark, docs):
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sum(60 <= i < 80 for i in ids if i is not None) == 1 and 60 in ids and ids.count(5) == 1 and ids.count(None) == 2
    assert jaccard.link_documents(rows.empty(spark)).count() == 0


# decontamination


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_hits_are_those_of_brute_force(spark, docs, texts, block_bytes):
    by_id = dict(texts)
    items = [(k, " ".join(spaced_text(by_id[20 + k])[10: 10 + n])) for k, n in enumerate((13, 20, 40, 12, 3))]
    items += [(7, "w1"), (8, None), (None, by_id[30]), (9, ""), (10, "w1"), (4, "w2 w3"), (11, " ".join(spaced_text(by_id[20])[10:23]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        if w and i is not None:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k: k + n])].add(i)
    found, hits = decontaminate.find_windows(docs, bench, block_bytes=block_bytes)
    seen = Counter()
    for x in found.select("doc_id", "text", hits.alias("h")).collect():
        words = alnum(x.text)
        hit, names = [False] * len(words), set()
        for w, i in windows.items():
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k: k + len(w)]) == w:
                    names |= i
                    hit[k: k + len(w)] = [True] * len(w)
        h = x.h
        assert (h.n_words, h.n_hit, h.items) == (len(words), sum(hit), sorted(names))
        covered = set()
        for a, b in zip(h.word_spans[::2], h.word_spans[1::2]):
            covered |= set(range(a, b))
        assert covered == {k for k, v in enumerate(hit) if v}
        data = (x.text or "").encode()
        spans = [alnum(data[a:b].decode()) for a, b in zip(h.byte_spans[::2], h.byte_spans[1::2])]
        assert [w for s in spans for w in s] == [w for w, v in zip(words, hit) if v]
        seen[sum(hit) > 0 and 20 * sum(hit) >= len(words)] += 1
    assert seen[True] and seen[False]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == seen[False]


def spaced_text(text):
    return [x.decode() for x in spaced(text)]


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 300):
        symbols = np.append(rng.integers(0, 4, n), 0).astype(np.int32)
        order = decontaminate.suffix_order(symbols)
        cut = [tuple(symbols[k: k + int(np.flatnonzero(symbols[k:] == 0)[0])]) for k in range(len(symbols))]
        assert [(cut[k], k) for k in order] == sorted((cut[k], k) for k in range(len(symbols)))
        index = decontaminate.FmIndex(symbols, 4)
        assert index.locate(np.arange(len(symbols))).tolist() == order.tolist()
        for k in range(len(symbols)):
            assert index.wavelet.rank(np.array([1, 2, 3]), np.array([k] * 3)).tolist() == [int((index.last[:k] == c).sum()) for c in (1, 2, 3)]


def test_decontamination_without_rows(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    found, hits = decontaminate.find_windows(docs, bench)
    assert found.where(hits["n_hit"] > 0).count() == 0 and found.count() == docs.count()
    found, hits = decontaminate.find_windows(rows.empty(spark), bench)
    assert found.count() == 0


# quality rules


def test_counts_are_those_of_brute_force(docs):
    judged, lines = line_labels.judge_lines(docs, line_labels.default_field())
    for x in judged.select("doc_id", "text", lines.alias("x")).collect():
        text = x.text or ""
        w = [y.decode() for y in spaced(text)]
        windows = Counter(tuple(w[k: k + 8]) for k in range(len(w) - 7))
        hit = [False] * len(w)
        for k in range(len(w) - 7):
            if windows[tuple(w[k: k + 8])] > 1:
                hit[k: k + 8] = [True] * 8
        full = [y for y in text.split("\n") if spaced(y)]
        got = (x.x.n_words, x.x.word_chars, x.x.n_symbols, x.x.n_dup_lines, x.x.n_repeat_words, x.x.n_lines)
        assert got == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), sum(hit), len(full))
        assert len(x.x.line_labels) == len(full)
        assert x.x.content_words == sum(len(spaced(y)) for y, mark in zip(full, x.x.line_labels) if not mark)


def test_decoding_finds_the_best_labels():
    rng = np.random.default_rng(5)
    field = line_labels.Field(rng.normal(size=line_labels.WIDTH), np.array([[0.7, -0.4], [-0.9, 0.6]]))
    lengths = [3, 1, 0, 6, 5]
    first = np.concatenate([[0], np.cumsum(lengths)])
    features = rng.integers(0, 2, (first[-1], line_labels.WIDTH)).astype(np.float32)
    labels = field.decode(line_labels.Lines(first, np.ones(first[-1], int), features))
    for a, b in zip(first[:-1], first[1:]):
        score = features[a:b] @ field.weights
        value = {}
        for mask in range(1 << (b - a)):
            y = [mask >> k & 1 for k in range(b - a)]
            value[tuple(y)] = sum(s for s, v in zip(score, y) if v) + sum(field.transitions[p, q] for p, q in zip(y, y[1:]))
        assert value[tuple(labels[a:b].tolist())] == pytest.approx(max(value.values()))


def test_field_and_rules_on_awkward_tables(spark, docs):
    for labelled in (rows.labels(spark), rows.labels(spark).limit(0)):
        kept = line_labels.keep_content(docs, labelled)
        assert kept.columns == docs.columns
        ids = {x.doc_id for x in kept.select("doc_id").collect()}
        assert not ids & {90, 91, 92, 93, 99} and 20 in ids
    assert line_labels.keep_content(rows.empty(spark), rows.labels(spark)).count() == 0


# classifier


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labelled = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    model = cotraining.train(docs, labelled.where(~fold))
    scored, quality = cotraining.score(docs, model)
    held = scored.select("doc_id", cotraining.accepted(quality).alias("ok")).join(labelled.where(fold), "doc_id")
    right = held.agg(F.avg((F.col("ok") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_classifier_on_awkward_tables(spark, docs):
    kept = cotraining.keep_good(docs, rows.labels(spark))
    assert kept.columns == docs.columns
    # labels of one kind, or none, reject nothing
    for labelled in (rows.labels(spark).where("quality = 1"), rows.labels(spark).limit(0)):
        assert cotraining.keep_good(docs, labelled).count() == docs.count()
    assert cotraining.keep_good(rows.empty(spark), rows.labels(spark)).count() == 0
    assert cotraining.keep_good(docs.drop("source", "n_chars"), rows.labels(spark)).count() > 0


# language model


@pytest.mark.parametrize("head", [5, 1 << 17])
def test_base_scores_are_those_of_brute_force(docs, texts, head):
    found = language_model.score_documents(docs, head).collect()
    tokens = [(i, [x.lower() for x in spaced(t)] + [b""]) for i, t in texts]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in tokens)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in found) == expected
    assert all(x.score < 0 and math.isfinite(x.score) for x in found)


def test_model_is_a_distribution_and_learns_from_training_only(spark, docs):
    code = language_model.huffman(np.arange(256) ** 2)
    assert sum(2.0 ** -code.length) == pytest.approx(1)
    scores = {x.doc_id: x.score for x in language_model.score_documents(docs).collect()}
    held = docs.where(language_model.held_out(F.col("doc_id")))
    assert held.count() > 3
    changed = docs.withColumn("text", F.when(language_model.held_out(F.col("doc_id")), F.concat(F.lit("other words "), F.col("text"))).otherwise(F.col("text")))
    gone = {i: x for i, x in scores.items() if i not in {y.doc_id for y in held.collect()}}
    again = {x.doc_id: x.score for x in language_model.score_documents(changed).collect()}
    assert all(again[i] == pytest.approx(x) for i, x in gone.items())
    # every first bit's two probabilities add up to one, so short words' do not exceed it
    assert language_model.score_documents(rows.empty(spark)).count() == 0
    none = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(x.n_known, x.train_tokens) for x in language_model.score_documents(none).collect()} == {(0, 0)}


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_WORDS", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for parts in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found.append({x.doc_id: x.score for x in language_model.score_documents(docs.repartition(parts + 1)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(found[0]) == 200 and found[0] == found[1]


def test_text_mixture_is_sequential():
    log_p = np.log(np.array([0.2, 0.1, 0.2, 0.2, 0.05]))
    token, owner, first = np.array([0, 1, 0, 0, 2]), np.array([0, 0, 0, 0, 1]), np.array([0, 4, 5])
    found = language_model.refine(token, owner, log_p, first)
    weights, total = np.full(len(language_model.RATES), 1 / len(language_model.RATES)), 0.0
    for k, seen in ((0, []), (1, [0]), (2, [0, 1]), (3, [0, 1, 0])):
        share = seen.count(token[k]) / max(1, len(seen))
        r = language_model.RATES * (len(seen) > 0)
        p = (1 - r) * np.exp(log_p[k]) + r * share
        total += np.log(weights @ p)
        weights = weights * p / (weights @ p)
    assert found == pytest.approx([total, log_p[4]])


def test_pairs_are_counted_exactly_and_shares_stay_below_one(spark):
    texts = ["the cat sat on the mat", "The  cat ran", "", "a dog ran on the cat", "odd one"] * 3
    docs = spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)
    words = sorted({w for x in texts for w in x.lower().encode().split()} - {b"odd"} | {b""})
    tokens = [[*x.lower().encode().split(), b""] for x in texts]
    counts = np.array([sum(x.count(w) for x in tokens) for w in words])
    brute = Counter((b, t) for x in tokens for b, t in zip([b"", *x[:-1]], x) if b in words)
    pairs = language_model.count_pairs(docs, words, counts)
    hashes = {w: int(language_model.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in {w for x in tokens for w in x}}

    def shares(before, token):
        return [x[0] for x in pairs.shares(*[np.array([hashes[w]], np.uint64) for w in (before, token)])]

    assert len(pairs.keys) == len(brute)
    for b in hashes:
        total = sum(n for (x, _), n in brute.items() if x == b)
        found = [shares(b, t) for t in hashes]
        assert [x[0] for x in found] == pytest.approx([brute[b, t] / total if total else 0 for t in hashes])
        assert {round(x[1], 9) for x in found} == {1.0 if total else 0.0}
        assert sum(x[0] for x in found) == pytest.approx(found[0][1])
    # a bound keeps whole steps of counts, from the top
    fewer = language_model.count_pairs(docs, words, counts, 5)
    assert 0 < len(fewer.keys) <= 5 and fewer.counts.min() > max(set(brute.values()) - set(fewer.counts.tolist()), default=0)


def test_every_pair_counts_whatever_the_size(spark):
    """Pairs behind frequent and rare words, over many shards and buckets, have the shares of brute force."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{int(k)}" for k in rng.zipf(1.3, 30) % 90) for _ in range(60)] + ["", "one", "one two"] * 2
    docs = spark.createDataFrame([(k, x, k % 5 == 0) for k, x in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(5)
    tokens = [[*x.lower().encode().split(), b""] for x in texts]
    training = [x for k, x in enumerate(tokens) if k % 5]
    counts = Counter((b, t) for x in training for b, t in zip([b"", *x[:-1]], x))
    totals = Counter(w for x in training for w in x)
    listed = [w for w, _ in totals.most_common(6)]
    hashes = language_model.word_hashes(*language_model._joined(listed))
    order = np.argsort(hashes)
    hot = language_model.Places(hashes[order])
    counted = language_model.counted_pairs(docs.withColumn("shard", F.col("doc_id") % 4), hot, 7)
    masses = language_model.hot_masses(counted, 6)
    for shard in range(4):
        lists = counted.where(F.col("shard") == shard).toArrow()
        mine = [x for k, x in enumerate(texts) if k % 4 == shard]
        data, offsets = language_model.byte_column(pa.array(mine))
        pairs = language_model.ShardPairs.of(data, offsets, lists, hot, np.array([totals[listed[k]] for k in order], float), masses, 7)
        share, mass = pairs.shares(*language_model.text_pairs(data, offsets))
        seen = [(b, t) for x in mine for y in [[*x.lower().encode().split(), b""]] for b, t in zip([b"", *y[:-1]], y)]
        often = {p: n for p, n in counts.items() if n > 1}
        assert share == pytest.approx([often.get(p, 0) / max(1, totals[p[0]]) for p in seen])
        assert mass == pytest.approx([sum(n for (b, _), n in often.items() if b == p[0]) / max(1, totals[p[0]]) for p in seen])


def test_messages_of_pairs_are_small(spark):
    """What shards send and get back of their pairs takes far less than hashes and counts written out."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.2, 400) % 5000) for _ in range(60)]
    docs = spark.createDataFrame([(k, x, False) for k, x in enumerate(texts)], "doc_id long, text string, held_out boolean").withColumn("shard", F.lit(0))
    listed = [w for w, _ in Counter(w for x in texts for w in x.encode().split()).most_common(500)]
    hot = language_model.Places(np.sort(language_model.word_hashes(*language_model._joined(listed))))
    back = language_model.counted_pairs(docs, hot, 2).where("shard >= 0").toArrow()
    pairs = sum(len(x) for x in language_model._unpacked(back.column("counts")))
    assert pairs > 5000 and sum(len(x) for c in ("counts", "totals", "masses") for x in back.column(c).to_pylist()) < 2 * pairs
    places = np.array([-1, 0, -1, 3, 4, -1])
    assert language_model._from_steps(language_model._steps(places)).tolist() == places.tolist()
    keys = rng.integers(0, 2**63, 50).astype(np.uint64)
    sent = language_model._key_bytes(keys)
    assert len(sent) == 250 and (language_model._short_keys(pa.chunked_array([[sent]], pa.binary())) == keys % 2**40).all()


def test_mixtures_of_shares_are_worked_out():
    log_p, word, pair, mass = np.log([0.1, 0.2]), np.array([0.3, 0.0]), np.array([0.5, 0.0]), np.array([0.75, 0.0])
    found = np.exp(language_model.with_shares(log_p, word, 0.9, pair, mass))
    for line, (a, b) in zip(found, language_model.SHARES):
        among = (1 - a * 0.9) * np.exp(log_p) + a * word
        assert line == pytest.approx((1 - b * mass) * among + b * pair)


def test_words_before_tell_what_comes(spark):
    """Texts in which each word settles the next: held-out scores have to use that, and beat the base."""
    rng = np.random.default_rng(5)
    following = rng.permutation(200)
    texts = []
    for start in rng.integers(0, 200, 400):
        chain = [start]
        for jump in rng.random(40) < 0.1:
            chain.append(rng.integers(200) if jump else following[chain[-1]])
        texts.append(" ".join(f"w{int(x) * 7919 % 100003}" for x in chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [x for x in language_model.score_documents(docs).collect() if x.held_out]
    assert sum(x.score for x in held) > 0.6 * sum(x.base_score for x in held)


def test_what_words_have_in_common_is_worked_out_once():
    """Words of one long beginning look up the bits of that beginning once, and have the probabilities they have alone."""
    rng = np.random.default_rng(6)

    class Counted:
        def __init__(self, table):
            self.table, self.seen = table, 0

        def __getitem__(self, places):
            self.seen += places.size
            return self.table[places]

    code = language_model.huffman(rng.integers(1, 1000, 256))
    counts = rng.integers(0, 50, (int(language_model.BOUNDS[-1]), 2)).astype(np.float32)
    mixer = language_model.Mixer.of(code, counts, language_model.START)
    words = [b"a" * 60 + b"%d" % k for k in range(200)] + [b""]
    alone = [mixer.words(*language_model._joined([w]))[0] for w in words]
    mixer.odds = Counted(mixer.odds)
    mixer.words(*language_model._joined(words[:1]))
    one, mixer.odds.seen = mixer.odds.seen, 0
    assert mixer.words(*language_model._joined(words)) == pytest.approx(alone)
    assert mixer.odds.seen < 30 * one
    assert mixer.words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    # a word of the same hash and other bytes is not in the head
    head = language_model.Head(words, np.ones(len(words)), np.zeros(len(words)), mixer)
    data, starts, ends = language_model._joined([words[3], words[5], b""])
    hashes = language_model.word_hashes(data, starts, ends)
    assert head.places(hashes, data, starts, ends).tolist() == [3, 5, 200]
    assert head.places(hashes[[1, 1, 0]], data, starts, ends).tolist() == [-1, 5, -1]


def test_frequent_tokens_go_by_place():
    """Three bytes for a pair whose token is frequent, hashes apart from all places for the others."""
    places, keys = np.array([0, 7, 0, 1 << 16], np.uint64), np.array([5, 1 << 39], np.uint64)
    sent = [language_model._key_bytes(places, language_model.PLACE_BYTES), language_model._key_bytes(keys)]
    found = language_model._second_words(*[pa.chunked_array([[x[:k], x[k:]]], pa.binary()) for x, k in zip(sent, (6, 5))])
    assert [len(x) for x in sent] == [12, 10] and found.tolist() == [5 + (1 << 24), 7, (1 << 39) + (1 << 24), 1 << 16]


def test_weights_are_learned_once(spark):
    """Learning is one job: a sort of its results would run it a second time for samples."""
    words = spark.createDataFrame([(b"w%d" % k, 1 + k % 7) for k in range(300)], "word binary, n long")
    counts = spark.sparkContext.broadcast(np.ones((int(language_model.BOUNDS[-1]), 2), np.float32))
    spark.sparkContext.setJobGroup("learn-once", "")
    try:
        weights = language_model.learn_weights(words, language_model.huffman(np.arange(256)), counts, 300)
        tracker = spark.sparkContext.statusTracker()
        stages = {x for job in tracker.getJobIdsForGroup("learn-once") for x in tracker.getJobInfo(job).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert weights.shape == (language_model.GATES, 3) and len(stages) <= 3


def test_counts_of_rare_words_come_with_their_pairs(docs):
    """No (text, rare word) rows are joined with the words: what a shard's pairs bring tells their counts."""
    found = language_model.score_documents(docs, 5)
    assert " Join " not in found._jdf.queryExecution().optimizedPlan().toString() and found.where("n_known < n_tokens").count() > 0


# licences


def test_licenses():
    scanner = licenses.Scanner()
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. In no event shall the authors or copyright holders be liable for any claim, '
        "damages or other liability."
    )
    assert scanner.licenses(scanner.identifiers(mit)) == ["MIT"]
    both = "Licensed under the Apache License, Version 2.0.\nText between. Released under the MIT License."
    assert scanner.licenses(scanner.identifiers(both)) == ["Apache-2.0", "MIT"]
    assert scanner.licenses(scanner.identifiers("This work is licensed under the GNU General Public License, version 3.")) == ["GPL-3.0"]
    assert scanner.licenses(scanner.identifiers("Licensed under CC BY-NC 4.0.")) == ["CC-BY-NC-4.0"]
    assert scanner.licenses(scanner.identifiers("This is under the Foo licence.")) == ["Unknown"]
    # a rule takes its sentences: the rest of the notice alone is another licence
    assert scanner.licenses(["MITGrant", "MITNotice", "MITName", "UnheardOf"]) == ["MIT"]
    assert scanner.licenses([]) == [] and scanner.identifiers("nothing here") == []


def test_license_scan_of_tables(spark, docs):
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert licenses.scan_licenses(rows.empty(spark)).count() == 0
