"""Language-model scores by online logistic context mixing over bits.

A token (a lower-cased word, or the end of a text) is coded byte by byte along a
Huffman tree of the corpus's bytes, so each byte is a few bits. For every bit three
predictors look up hashed contexts (the two bytes before, the four bytes before, the
word so far) in tables of counts from all training texts. Their log-odds are combined
by weights that a gate selects by how often the contexts were seen; the weights are
learned online, by Newton steps over the training words with each word's own count
left out. What bits cost depends on the word alone, so tables and weights are sums
over the distinct words of the corpus, and a shard's texts cost one evaluation per
distinct word.

Across words, the result of the bits is mixed with the share of the token behind the
word before it, from counts of word pairs, and with its share among all tokens, and
within a text with its share among the tokens before it. Rates of these mixtures
compete by how well they did so far in the text. All pairs of all words are counted:
texts are put in shards, the distinct pairs of a shard go to the buckets that count
them, and their counts come back to the shard. Each share is spread over no more than
its own mass, so the probabilities of all tokens add up to at most one.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import SPACED, byte_column, lowered, mix, prefix_hashes, range_hashes, settle, slabs, vector_sum, word_hashes, word_spans

HELD_OUT = (7, 2)
SLAB = 2 << 20
#: most frequent words that go to every task; counts of the others come with the pairs
HEAD_WORDS = 1 << 17
#: slots of the three tables, as powers of two: their size bounds what is broadcast
POWERS = (16, 20, 22)
BOUNDS = np.concatenate([[0], np.cumsum([1 << x for x in POWERS])])
LEAD = 4
GATES = 21
#: weights before training: the longer contexts count more the oftener they were seen
START = np.array([[1, 0, 0]] + [[0.3, 0.7, 0]] * 10 + [[0.1, 0.4, 0.6]] * 10, np.float32)
#: added to counts
FEW = 0.1
BATCH, STEP, STEP_BYTES = 1 << 15, 1 << 17, 1 << 15
#: distinct words whose bits one learner of weights sees
BUCKET_WORDS = 1 << 15
#: rates at which a text's own tokens are mixed in
RATES = np.array([0.0, 0.01, 0.03, 0.08, 0.2, 0.45])
#: rates of a token's share among all tokens, and behind the word before it
SHARES = ((0.0, 0.0), (0.5, 0.0), (0.95, 0.0), (0.5, 0.4), (0.95, 0.8))
#: pairs that one task counts at a time, as they come from the shards
BUCKET_PAIRS = 1 << 20
#: bytes of a pair's hash that a shard sends: they tell apart the pairs behind one word in one bucket
KEY_BYTES = 5
#: bytes of a frequent token's place, which is sent instead
PLACE_BYTES = 3
#: most pairs of words that ``count_pairs`` brings to one place
HEAD_PAIRS = 1 << 20
#: slots that pairs are first counted in, as a power of two, and the share of them that is counted exactly
PAIR_POWER, PAIR_SHARE = 20, 4
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null doc_id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


@dataclass
class Code:
    """Bits of each byte value, and the tree node that each bit is decided at."""

    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """Code of 256 byte values, each with one more than its count."""
    heap = [(int(n) + 1, k, (k,)) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        (n, _, left), (m, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, values in ((0, left), (1, right)):
            for v in values:
                paths[v].append((node, bit))
        heapq.heappush(heap, (n + m, 256 + node, left + right))
    length = np.array([len(x) for x in paths], np.int64)
    nodes, bits = np.zeros((length.max(), 256), np.uint32), np.zeros((length.max(), 256), bool)
    for v, path in enumerate(paths):
        for level, (node, bit) in enumerate(reversed(path)):
            nodes[level, v], bits[level, v] = node, bit
    return Code(length, nodes, bits)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all lower-cased words of the texts, and for the end of each text the row with the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slabs(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts.update((text or "").encode().lower().split())
            counts[b""] += batch.num_rows
            if len(counts) > 300_000:
                yield counted(counts)
                counts = Counter()
        if counts:
            yield counted(counts)

    def counted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte value occurs in the serial form of the counted texts."""
    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(256)
        for batch in batches:
            data, offsets = byte_column(batch.column("word"))
            n = batch.column("n").to_numpy().astype(np.float64)
            total += np.bincount(data, np.repeat(n, np.diff(offsets)), 256)
            ends = np.diff(offsets) == 0
            total[10] += n[ends].sum()
            total[32] += n[~ends].sum() - n[ends].sum()
        return np.maximum(total, 0)

    return vector_sum(words, fold, 256)


@dataclass
class Bits:
    """Every bit of some words, level by level: word, value and table slots; ``slots`` has a line per context."""

    word: np.ndarray
    value: np.ndarray
    slots: np.ndarray


def _symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word, value and three contexts of every byte of words given as ranges of bytes; a space closes a word, and the empty word is the end of a text."""
    size = ends - starts
    length = size + 1 + LEAD
    begin = np.cumsum(length) - length
    text = np.zeros(int(length.sum()), np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begin + LEAD, size) + within] = data[np.repeat(starts, size) + within]
    text[begin + length - 1] = np.where(size > 0, 32, 10)
    owner = np.repeat(np.arange(len(size)), size + 1)
    at = np.arange(len(owner)) + (owner + 1) * LEAD
    sums = prefix_hashes(text)
    near = text[at - 1].astype(np.uint32) | text[at - 2].astype(np.uint32) << np.uint32(8)
    four = near | text[at - 3].astype(np.uint32) << np.uint32(16) | text[at - 4].astype(np.uint32) << np.uint32(24)
    return owner, text[at], [near, four, range_hashes(sums, begin[owner], at)]


def bits_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: Code) -> Bits:
    """Bits of words given as ranges of bytes."""
    return _bits(*_symbols(data, starts, ends), code)


def _bits(owner: np.ndarray, symbols: np.ndarray, contexts: list[np.ndarray], code: Code) -> Bits:
    near, four, prefix = contexts
    prefix = (prefix >> np.uint64(32)).astype(np.uint32)
    left = code.length[symbols]
    active = np.arange(len(symbols), dtype=np.int32)
    parts: list[tuple] = []
    while len(active):
        level = len(parts)
        here = symbols[active]
        node = (code.nodes[level][here] + np.uint32(1)) * np.uint32(0x85EBCA6B)
        slots = np.empty((3, len(active)), np.int32)
        for k, context in enumerate((near, four, prefix)):
            y = (context[active] * np.uint32(0x9E3779B1) ^ node) * np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x297A2D39)
            slots[k] = (y >> np.uint32(32 - POWERS[k])).astype(np.int32) + np.int32(BOUNDS[k])
        parts.append((owner[active], code.bits[level][here], slots))
        active = active[left[active] > level + 1]
    if not parts:
        return Bits(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((3, 0), np.int32))
    return Bits(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts], axis=1))


def _word_batches(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[tuple[Bits, np.ndarray]]:
    for batch in slabs(batches, "word", 1 << 18):
        data, offsets = byte_column(batch.column("word"))
        yield bits_of(data, offsets[:-1], offsets[1:], code), batch.column("n").to_numpy()


def count_bits(words: DataFrame, code: Code) -> np.ndarray:
    """Ones and zeros of all training tokens per slot."""
    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for bits, n in _word_batches(batches, code):
            total = np.zeros(2 * BOUNDS[-1]) if total is None else total
            times = n[bits.word].astype(np.float64)
            for slots in bits.slots:
                np.add.at(total, slots * 2 + bits.value, times)
        return total

    # few and long tasks: each sends one table
    few = words.coalesce(max(1, words.sparkSession.sparkContext.defaultParallelism))
    return vector_sum(few, fold, 2 * int(BOUNDS[-1]), "<f4", 8192).reshape(-1, 2)


def _grade(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """How much a context's counts say: 0 for none, then by their number, with and without both values among them."""
    seen = ones + zeros
    grade = sum(((seen > x).view(np.uint8) for x in (2, 6, 40, 400)), np.uint8(1)) + np.uint8(5) * (np.minimum(ones, zeros) > 0)
    return np.where(seen > 0, grade, np.uint8(0))


def _gates(four: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Gate by the grade of the word so far, or where it is new, of the four bytes before."""
    return np.where(prefix > 0, 10 + prefix, four).astype(np.int32)


def _log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + FEW) / (zeros + FEW))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def learn_weights(words: DataFrame, code: Code, counts, distinct: int) -> np.ndarray:
    """Gated weights by online Newton steps over the words of a bucket; those of all buckets are averaged by the tokens behind them.

    Buckets go by the words' checksums, some ``BUCKET_WORDS`` of the ``distinct`` words to
    each, and are read and added up in a fixed order, so that the weights don't depend on
    partitions, retries or the number of executors. A bucket sends a few hundred numbers.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weights, mass = START.astype(np.float64), np.zeros((GATES, 1))
        curve = np.tile(np.eye(3) * 10, (GATES, 1, 1))
        for bits, n in _word_batches(batches, code):
            table = counts.value
            for begin in range(0, len(bits.value), STEP):
                part = slice(begin, begin + STEP)
                value, times = bits.value[part], n[bits.word[part]].astype(np.float64)
                # what the counts say without one occurrence of the word itself
                seen = [table[x[part]] for x in bits.slots]
                ones, zeros = [np.stack([np.maximum(x[:, k] - (value == k), 0) for x in seen]) for k in (1, 0)]
                inputs, gate = _log_odds(ones, zeros), _gates(*_grade(ones[1:], zeros[1:]))
                p = _squash((weights[gate].T * inputs).sum(axis=0))
                pull = (value - p) * times
                step = np.stack([np.bincount(gate, pull * x, GATES) for x in inputs], axis=1)
                spread = times * p * (1 - p)
                for i in range(3):
                    for j in range(i, 3):
                        more = np.bincount(gate, spread * inputs[i] * inputs[j], GATES)
                        curve[:, i, j] += more
                        if i != j:
                            curve[:, j, i] += more
                weights += np.linalg.solve(curve, step[:, :, None])[:, :, 0]
                mass += np.bincount(gate, times, GATES)[:, None]
        return np.concatenate([(weights * mass).ravel(), mass.ravel()])

    def learn(rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by([("mark", "ascending"), ("word", "ascending")]).combine_chunks()
        return pa.table({"bucket": rows.column("bucket")[:1], "numbers": pa.array([fold(iter(ordered.to_batches())).tobytes()], pa.binary())})

    mark = F.crc32("word")
    marked = words.select("word", "n", mark.alias("mark"), F.pmod(mark, F.lit(distinct // BUCKET_WORDS + 1)).cast("int").alias("bucket"))
    parts = marked.groupBy("bucket").applyInArrow(learn, "bucket int, numbers binary").collect()
    sums = np.zeros(4 * GATES)
    # put in order here: a sort by Spark would look at samples first, for which all buckets are learned once more
    for x in sorted(parts, key=lambda x: x.bucket):
        sums += np.frombuffer(x.numbers)
    mass = sums[3 * GATES:].reshape(GATES, 1)
    return np.where(mass > 0, sums[: 3 * GATES].reshape(GATES, 3) / np.maximum(mass, 1e-9), START).astype(np.float32)


@dataclass
class Mixer:
    code: Code
    odds: np.ndarray
    grades: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, code: Code, counts: np.ndarray, weights: np.ndarray) -> "Mixer":
        return cls(code, _log_odds(counts[:, 1], counts[:, 0]).astype(np.float32), _grade(counts[:, 1], counts[:, 0]), weights)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word as a token; what words have in common up to a byte is worked out once."""
        out = np.zeros(len(starts))
        for begin in range(0, len(starts), BATCH):
            part = slice(begin, begin + BATCH)
            owner, symbols, contexts = _symbols(data, starts[part], ends[part])
            _, place, prefix = distinct_places(pair_hashes(contexts[2], symbols.astype(np.uint64)))
            costs = [self._bytes(symbols[x], [c[x] for c in contexts]) for x in (place[k: k + STEP_BYTES] for k in range(0, len(place), STEP_BYTES))]
            if costs:
                out[part] = np.bincount(owner, np.concatenate(costs)[prefix], len(starts[part]))
        return out

    def _bytes(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        bits = _bits(np.arange(len(symbols)), symbols, contexts, self.code)
        gate = _gates(*self.grades[bits.slots[1:]])
        mixed = sum(self.weights[:, k][gate] * self.odds[bits.slots[k]] for k in range(3))
        # log-probability of the bit that came
        x = np.clip(np.where(bits.value, mixed, -mixed), -12, 12)
        return np.bincount(bits.word, -np.log1p(np.exp(-x)), len(symbols))


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers, a place of each, and of each place which number it has; ``np.unique`` keeps the first place, for which it sorts more slowly."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in words], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends


class Head:
    """The most frequent words: base score, count and log-probability of each, looked up by hash; ``order`` is that of their hashes, in which ``find`` has them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, base: np.ndarray, mixer: Mixer):
        self.data, self.starts, self.ends = _joined(words)
        hashes = word_hashes(self.data, self.starts, self.ends) if words else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.find = Places(hashes[self.order])
        self.base = np.append(base, 0.0)
        self.counts = np.append(counts, 0).astype(np.float64)
        self.log_p = np.append(mixer.words(self.data, self.starts, self.ends), 0.0)

    def places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for none; words of one hash are told apart by their bytes."""
        out = np.append(self.order, -1)[self.find(hashes)]
        found = np.flatnonzero(out >= 0)
        place, size = out[found], ends[found] - starts[found]
        equal = size == self.ends[place] - self.starts[place]
        found, place, size = found[equal], place[equal], size[equal]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        other = data[np.repeat(starts[found], size) + within] != self.data[np.repeat(self.starts[place], size) + within]
        same = np.bincount(np.repeat(np.arange(len(found)), size), other, len(found)) == 0
        out[:] = -1
        out[found[same]] = place[same]
        return out


def pair_hashes(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def text_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before and of each token, text after text; ends have that of the empty word, and so has what is before a text."""
    starts, ends, first = word_spans(data, offsets, SPACED)
    token = np.insert(word_hashes(lowered(data, SPACED), starts, ends), first[1:], np.uint64(0))
    return np.concatenate([np.zeros(1, np.uint64), token[:-1]]), token


class Places:
    """Places of sorted hashes, by way of their first bits, since hashes lie evenly."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each number, -1 for none."""
        out = np.full(len(wanted), -1)
        group = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[group], self.first[group + 1]
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            equal = self.keys[at] == wanted[todo]
            out[todo[equal]] = at[equal]
            at = at + 1
            more = ~equal & (at < end)
            todo, at, end = todo[more], at[more], end[more]
        return out


@dataclass
class Pairs:
    """Counts of pairs of words by hash, and of each first word its count and how much of it the pairs make up."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    masses: np.ndarray

    def __post_init__(self):
        self.find_pair, self.find_context = Places(self.keys), Places(self.contexts)

    def shares(self, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each token behind the word before it, and the sum of the shares of all tokens there."""
        context = self.find_context(before)
        mass = np.append(self.masses, 0.0)[context]
        share = np.zeros(len(token))
        known = np.flatnonzero(mass > 0)
        place = self.find_pair(pair_hashes(before[known], token[known]))
        seen = place >= 0
        share[known[seen]] = self.counts[place[seen]] / self.totals[context[known[seen]]]
        return share, mass


def count_pairs(texts: DataFrame, words: list[bytes], counts: np.ndarray, limit: int = HEAD_PAIRS) -> Pairs:
    """Exact counts of the at most ``limit`` most frequent pairs that follow one of ``words``, those of one occurrence apart.

    For corpora whose pairs fit in one place; ``score_documents`` counts all by ``counted_pairs``.
    Pairs are first counted by slot; those of the fullest slots are then counted one by
    one, so a shuffle carries a part of the pairs only. What is kept goes by counts alone:
    steps of counts from the top, as many as fit whole.
    """
    spark = texts.sparkSession
    hashes = word_hashes(*_joined(words)) if words else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    contexts, totals = hashes[order], np.asarray(counts, np.float64)[order]
    find = Places(contexts)
    known = spark.sparkContext.broadcast(find)

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        before, token = text_pairs(*byte_column(batch.column("text")))
        inside = known.value(before) >= 0
        return before[inside], pair_hashes(before[inside], token[inside])

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in slabs(batches, "text"):
            total = np.zeros(1 << PAIR_POWER) if total is None else total
            np.add.at(total, (keyed(batch)[1] >> np.uint64(64 - PAIR_POWER)).astype(np.int64), 1.0)
        return total

    few = texts.coalesce(max(1, spark.sparkContext.defaultParallelism))
    slots = vector_sum(few, fold, 1 << PAIR_POWER, "<f8", 8192)
    full = np.partition(slots, len(slots) - len(slots) // PAIR_SHARE)[len(slots) - len(slots) // PAIR_SHARE]
    marks = spark.sparkContext.broadcast(np.packbits(slots >= max(2, full)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(marks.value).astype(bool)
        for batch in slabs(batches, "text", SLAB):
            before, key = keyed(batch)
            chosen = marked[(key >> np.uint64(64 - PAIR_POWER)).astype(np.int64)]
            key, place, n = np.unique(key[chosen], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(before[chosen][place].view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "word", "n"]
            )

    pairs = texts.mapInArrow(count, "pair long, word long, n long").groupBy("pair").agg(F.min("word").alias("word"), F.sum("n").alias("n")).where("n > 1")
    pairs = settle(pairs.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "pairs")
    least, kept = 1 << 20, 0
    for step, n in sorted(((x.step, x.count_) for x in pairs.groupBy("step").agg(F.count("*").alias("count_")).collect()), reverse=True):
        kept += n
        if kept > limit:
            break
        least = step
    found = pairs.where(F.col("step") >= least).select("pair", "word", "n").toArrow()
    key, word, n = [found.column(x).to_numpy() for x in ("pair", "word", "n")]
    key = key.astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    place = find(word.astype(np.int64).view(np.uint64))
    masses = np.bincount(place, n, len(contexts)) / np.maximum(totals, 1) if len(contexts) else np.zeros(0)
    return Pairs(key[order], n[order].astype(np.float64), contexts, totals, masses)


@dataclass
class Tokens:
    """The tokens of texts by number: 0 is the end of a text, words are numbered by growing hash; each word's bytes are a range of ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    token: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> "Tokens":
        starts, ends, first = word_spans(data, offsets, SPACED)
        data = lowered(data, SPACED)
        hashes, place, word = distinct_places(word_hashes(data, starts, ends))
        none = np.zeros(1, np.int64)
        return cls(
            data, np.append(none, starts[place]), np.append(none, ends[place]), np.append(np.uint64(0), hashes),
            np.insert(word + 1, first[1:], 0), first + np.arange(len(first)),
        )

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


@dataclass
class DistinctPairs:
    """Each distinct pair of a shard, by bucket, word before (by hash) and token; ``pair`` tells which one each token makes with the word before it."""

    bucket: np.ndarray
    first: np.ndarray
    before: np.ndarray
    key: np.ndarray
    token: np.ndarray
    hot: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, tokens: Tokens, hot: Places, buckets: int) -> "DistinctPairs":
        """All pairs behind a word are in one bucket, which so knows how many there are; those of the frequent
        words ``hot`` are spread over all buckets. The order of the texts doesn't matter.
        """
        words = len(tokens.hashes)
        before = np.append(0, tokens.token[:-1])[: len(tokens.token)]
        number, _, pair = distinct_places(before * words + tokens.token)
        first, token = np.divmod(number, words)
        before = tokens.hashes[first]
        key, place = pair_hashes(before, tokens.hashes[token]), hot(tokens.hashes)[first]
        spread = mix(np.where(place >= 0, key, before))
        bucket = (spread >> np.uint64(32)) % np.uint64(buckets)
        # numbers of two bytes are sorted by counting
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        return cls(bucket[order].astype(np.int64), first[order], before[order], key[order], token[order], place[order], moved[pair])


def _heads(bucket: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a pair is the first behind its word, in the order of ``DistinctPairs``."""
    return np.append(True, (before[1:] != before[:-1]) | (bucket[1:] != bucket[:-1]))[: len(before)]


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers as bytes; most are far below the size that the largest needs."""
    return zlib.compress(numbers.astype("<u4").tobytes(), 1)


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), "<u4") for x in column.to_pylist()]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, "<u4"), *_unpacked(column)])


def _steps(places: np.ndarray) -> np.ndarray:
    """Growing places as steps of 1 at least, between them 0 where a place is -1."""
    steps = np.zeros(len(places), np.int64)
    known = places >= 0
    steps[known] = np.diff(places[known], prepend=-1)
    return steps


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.where(steps > 0, np.cumsum(steps, dtype=np.int64) - 1, -1)


def _key_bytes(keys: np.ndarray, size: int = KEY_BYTES) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _short_keys(column: pa.ChunkedArray, size: int = KEY_BYTES) -> np.ndarray:
    cut = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)
    keys = np.zeros((len(cut), 8), np.uint8)
    keys[:, :size] = cut
    return keys.view("<u8").ravel()


def _second_words(places: pa.ChunkedArray, rest: pa.ChunkedArray) -> np.ndarray:
    """One number for each token that pairs were sent with: its place plus one, or what was sent of the pair's hash, above all places."""
    out = _short_keys(places, PLACE_BYTES)
    out[out == 0] = _short_keys(rest) + np.uint64(1 << 8 * PLACE_BYTES)
    return out


def counted_pairs(sharded: DataFrame, hot: Places, buckets: int) -> DataFrame:
    """What the pairs of each shard of (shard, text, held_out) count in all training texts: (shard, bucket, counts, totals, masses).

    A row has the counts of the shard's pairs in a bucket, those of one occurrence as 0,
    and of each word before them how often it occurs and how much of that the counts make
    up, in the order of ``DistinctPairs``; numbers are packed. Of the words ``hot`` a bucket
    knows its part of the mass only: rows of shard -1 have their places in ``totals`` and
    the parts in ``masses``. A shard sends the number of pairs of each word before, once,
    and of each pair the place of its token plus one, or 0 and some bytes of its hash where
    the token is not frequent; a frequent word before goes by its place, as the step from
    the one before, and any other as step 0 and its hash.
    """
    known = sharded.sparkSession.sparkContext.broadcast(hot)

    def send(texts: pa.Table) -> pa.Table:
        train = ~np.array(texts.column("held_out").to_pylist(), bool)
        tokens = Tokens.of(*_text_bytes(texts))
        found = DistinctPairs.of(tokens, known.value, buckets)
        bucket, before, key = found.bucket, found.before, found.key
        token = (known.value(tokens.hashes) + 1).astype(np.uint64)[found.token]
        n = np.bincount(found.pair, np.repeat(train, np.diff(tokens.first)), len(key))
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        heads = np.flatnonzero(_heads(bucket, before))
        sizes, words, places = np.diff(np.append(heads, len(bucket))), before[heads], found.hot[heads]
        parts = [slice(a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])]
        first = np.searchsorted(heads, cuts)
        groups = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(heads)])]
        return pa.table({
            "bucket": pa.array(bucket[cuts]), "shard": pa.array(np.full(len(cuts), texts.column("shard")[0].as_py())),
            "steps": pa.array([_packed(_steps(places[g])) for g in groups], pa.binary()),
            "words": pa.array([words[g][places[g] < 0].tobytes() for g in groups], pa.binary()), "sizes": pa.array([_packed(sizes[g]) for g in groups], pa.binary()),
            "tokens": pa.array([_key_bytes(token[p], PLACE_BYTES) for p in parts], pa.binary()),
            "pairs": pa.array([_key_bytes(key[p][token[p] == 0]) for p in parts], pa.binary()), "n": pa.array([_packed(n[p]) for p in parts], pa.binary()),
        })

    def count(rows: pa.Table) -> pa.Table:
        at = np.concatenate([_from_steps(x) for x in _unpacked(rows.column("steps"))])
        named = np.append(known.value.keys, np.uint64(0))[at]
        named[at < 0] = np.frombuffer(b"".join(rows.column("words").to_pylist()), "<u8")
        before = np.repeat(named, _numbers(rows.column("sizes")))
        # a pair is its word before and what was sent of its token
        key = pair_hashes(before, _second_words(rows.column("tokens"), rows.column("pairs")))
        times = _unpacked(rows.column("n"))
        n, ends = np.concatenate(times), np.cumsum([len(x) for x in times])
        shard = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        distinct, place, pair = distinct_places(key)
        occurrences = np.bincount(pair, n, len(distinct))
        counts = np.where(occurrences > 1, occurrences, 0)
        words, _, word = distinct_places(before[place])
        totals, masses = np.bincount(word, occurrences, len(words)), np.bincount(word, counts, len(words))
        heads = _heads(shard, before)
        first, of = np.cumsum(heads), word[pair[heads]]
        columns: list[list] = [[], [], []]
        for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            at = of[first[begin] - 1: first[end - 1]]
            for column, x in zip(columns, (counts[pair[begin:end]], totals[at], masses[at])):
                column.append(_packed(x))
        places = known.value(words)
        frequent = np.flatnonzero((places >= 0) & (masses > 0))
        for column, x in zip(columns, (places[:0], places[frequent], masses[frequent])):
            column.append(_packed(x))
        return pa.table({
            "shard": pa.array([*rows.column("shard").to_pylist(), -1], pa.int64()), "bucket": pa.array([rows.column("bucket")[0].as_py()] * (len(ends) + 1), pa.int64()),
            **{name: pa.array(x, pa.binary()) for name, x in zip(("counts", "totals", "masses"), columns)},
        })

    sent = sharded.groupBy("shard").applyInArrow(send, "bucket long, shard long, steps binary, words binary, sizes binary, tokens binary, pairs binary, n binary")
    return settle(sent.groupBy("bucket").applyInArrow(count, "shard long, bucket long, counts binary, totals binary, masses binary"), "pairs")


def hot_masses(counted: DataFrame, size: int) -> np.ndarray:
    """How much of the occurrences of each frequent word the counts of ``counted_pairs`` make up."""
    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for places, masses in zip(_unpacked(batch.column("totals")), _unpacked(batch.column("masses"))):
                total = np.zeros(size) if total is None else total
                total[places] += masses
        return total

    return vector_sum(counted.where("shard < 0"), fold, size, "<f8", 8192)


def _text_bytes(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return byte_column(pa.concat_arrays([x.cast(pa.large_string()) for x in texts.column("text").chunks]))


@dataclass
class ShardPairs:
    """Of each distinct pair of a shard, its share behind the word before it, and the sum of the shares of all tokens there; of each word outside ``hot`` its count.

    Every token but the last end has one behind it, and so has what is before a text, as
    often as there are ends: a word's occurrences before others are all it has.
    """

    pairs: DistinctPairs
    share: np.ndarray
    mass: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, *known) -> "ShardPairs":
        return cls.among(Tokens.of(data, offsets), *known)

    @classmethod
    def among(cls, tokens: Tokens, lists: pa.Table, hot: Places, hot_totals: np.ndarray, hot_masses: np.ndarray, buckets: int) -> "ShardPairs":
        pairs = DistinctPairs.of(tokens, hot, buckets)
        lists = lists.sort_by("bucket")
        counts, totals, masses = (_numbers(lists.column(c)).astype(np.float64) for c in ("counts", "totals", "masses"))
        heads, place = _heads(pairs.bucket, pairs.before), pairs.hot
        word = np.cumsum(heads) - 1
        total = np.maximum(np.where(place >= 0, np.append(hot_totals, 0.0)[place], totals[word]), 1)
        mass = np.where(place >= 0, np.append(hot_masses, 0.0)[place], masses[word])
        alone = heads & (place < 0)
        of_word = np.zeros(len(tokens.hashes))
        of_word[pairs.first[alone]] = totals[word[alone]]
        return cls(pairs, counts / total, mass / total, of_word)

    def shares(self, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.pairs.key)
        place = order[np.searchsorted(self.pairs.key, pair_hashes(before, token), sorter=order)]
        return self.share[place], self.mass[place]


def with_shares(log_p: np.ndarray, word: np.ndarray, word_mass: float, pair: np.ndarray, pair_mass: np.ndarray, token=slice(None)) -> np.ndarray:
    """Log-probability of each token by each of the rates ``SHARES``: shares among all tokens, then behind the word before, mixed in.

    ``log_p`` and ``word`` are those of the words that ``token`` numbers.
    """
    with np.errstate(divide="ignore"):
        among = {a: np.logaddexp(log_p + np.log1p(-a * word_mass), np.log(a * word))[token] for a in {a for a, _ in SHARES}}
    seen = np.flatnonzero(pair > 0)
    out = []
    for a, b in SHARES:
        p = among[a]
        if b:
            p = p + np.log1p(-b * pair_mass)
            p[seen] = np.logaddexp(p[seen], np.log(b * pair[seen]))
        out.append(p)
    return np.stack(out)


def refine(token: np.ndarray, owner: np.ndarray, log_p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-probability of each text: predictions and fixed rates of its own earlier tokens, weighed as it goes on.

    ``token`` numbers the words, text after text from ``first`` on; ``log_p`` has a
    number for each, or a line of them for each of several predictions. A mixture over
    rates of the products over tokens is the product of predictions that weigh each
    rate by its success so far.
    """
    size, places = len(token), np.arange(len(token))
    # text, word and place in one number: a slab has few texts or a bounded number of bytes
    key = np.sort((owner * (int(token.max(initial=0)) + 1) + token) * size + places)
    order, group = key % size, key // size
    same = np.append(False, group[1:] == group[:-1])
    earlier = np.empty(size, np.int64)
    earlier[order] = places - np.maximum.accumulate(np.where(same, 0, places))
    before = places - first[owner]
    share = earlier / np.maximum(before, 1)
    again = share > 0
    own, again_of = np.log(share[again]), owner[again]
    n = len(first) - 1
    predictions, follows = np.atleast_2d(log_p), np.add.reduceat((before > 0).astype(np.int64), first[:-1])
    sums = np.empty((len(RATES) * len(predictions), n))
    for k, one in enumerate(predictions):
        alone = np.add.reduceat(one, first[:-1])
        # by what factor a token's own share exceeds the prediction, as far as numbers go, and the rest as a logarithm
        excess = own - one[again]
        over = np.maximum(excess - 500, 0)
        factor = np.exp(excess - over)
        for j, rate in enumerate(RATES):
            gain = np.log1p(factor * (rate / (1 - rate))) + over if rate else np.zeros(len(own))
            sums[k * len(RATES) + j] = alone + np.log1p(-rate) * follows + np.bincount(again_of, gain, n)
    top = sums.max(axis=0)
    return top + np.log(np.exp(sums - top).mean(axis=0))


def shard_columns(tokens: Tokens, mixer: Mixer, head: Head, pairs: ShardPairs, total: int, odds: float) -> list[pa.Array]:
    """Tokens, known tokens, bytes, base score and score of each text of a shard; ``odds`` is the base score of a word without count."""
    token, owner, n = tokens.token, tokens.owner, len(tokens.first) - 1
    known = head.places(tokens.hashes, tokens.data, tokens.starts, tokens.ends)
    new = np.flatnonzero(known < 0)
    log_p, base, counts = head.log_p[known], head.base[known], head.counts[known]
    log_p[new] = mixer.words(tokens.data, tokens.starts[new], tokens.ends[new])
    counts[new] = pairs.counts[new]
    base[new] = np.log10(counts[new] + 1) + odds
    among = head.counts / max(1, total)
    # worked out once for each distinct pair
    shares = with_shares(log_p, among[known], float(among.sum()), pairs.share, pairs.mass, pairs.pairs.token)
    score = refine(token, owner, shares[:, pairs.pairs.pair], tokens.first) / np.log(10)
    sizes = tokens.ends - tokens.starts + 1
    sums = [np.bincount(owner, x[token], n) for x in (counts > 0, sizes, base)]
    return [pa.array(np.diff(tokens.first)), *[pa.array(x.astype(np.int64)) for x in sums[:2]], pa.array(sums[2]), pa.array(score)]


def score_documents(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of (doc_id, text).

    Counts and tables come from the rows that ``held_out`` leaves to training; nothing
    of a held-out text reaches another text's score. Tokens are lower-cased words and
    one end. ``base_score`` sums log10((c + 1) / (N + V + 1)) over them, ``score`` is
    the model's log10-probability of the same tokens. The ``head_words`` most frequent
    words go to every task; pairs of words are counted all, and by them, so by hashes of 64 bits, any other word. Null text is the empty text, one
    end. Repeated rows are scored each and counted each; with no training rows, counts
    are zero and every bit costs one bit. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    head_words = min(head_words, (1 << 8 * PLACE_BYTES) - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    words = settle(word_counts(training), "word-counts")
    total, distinct, size = (x or 0 for x in words.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * (F.octet_length("word") + 1))).first())
    code = huffman(byte_counts(words))
    counts = count_bits(words, code)
    sent = spark.sparkContext.broadcast(counts)
    mixer = Mixer.of(code, counts, learn_weights(words, code, sent, distinct))
    sent.destroy()
    del counts
    odds = float(np.log10(1.0 / (total + distinct + 1)))
    frequent = words.orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    listed, times = frequent.column("word").to_pylist(), frequent.column("n").to_numpy()
    head = Head(listed, times, np.log10(times + 1) + odds, mixer)
    hot = head.find
    # numbers of shards and buckets by the training texts; the texts kept from training are fewer
    shards, buckets = 1 + size // SLAB, 1 + total // BUCKET_PAIRS
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    counted = counted_pairs(sharded, hot, buckets)
    shared = spark.sparkContext.broadcast((mixer, head, total, hot, times[head.order].astype(np.float64), hot_masses(counted, len(listed)), buckets))

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        mixer, head, total, *pairs = shared.value
        tokens = Tokens.of(*_text_bytes(texts))
        columns = shard_columns(tokens, mixer, head, ShardPairs.among(tokens, lists, *pairs), total, odds)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score"])

    scored = sharded.groupBy("shard").cogroup(counted.where("shard >= 0").groupBy("shard")).applyInArrow(run, SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
