"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a slice of a task's texts. Its words become symbols: those that occur in
the benchmark have numbers, runs of other words and ends of texts are breaks. Over
the symbols stand a suffix order, its last column in a wavelet matrix for ranks, and
sampled suffix positions. All benchmark windows go through backward search at once;
the rows they end in are located by walks to a sampled position, and the places are
merged to spans to remove.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import ALNUM, byte_column, byte_table, lowered, settle, slabs, word_hashes, word_spans

WINDOW = 13
SHARD_BYTES = 2 << 20
#: benchmark text whose windows go to the tasks at once; more is searched in further passes
BLOCK_BYTES = 4 << 20
SAMPLE = 16
FIELDS = {"n_words": "long", "n_hit": "long", "items": "array<long>", "word_spans": "array<long>", "byte_spans": "array<long>"}


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order; a break (0) ends a suffix, and earlier places come first among equals.

    The last symbol has to be a break. Keys of several symbols are sorted once; then
    only suffixes that are still equal are sorted again by what follows, twice as far
    each time.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    depth = max(1, min(8, 62 // bits))
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(depth):
        following = np.zeros(n, np.int64)
        following[: max(0, n - k)] = symbols[k:]
        key = (key << bits) | np.where(open_, following, 0)
        open_ &= following > 0
    order = np.argsort(key)
    key = key[order]
    places = np.arange(n)
    next_break = np.minimum.accumulate(np.where(symbols == 0, places, n)[::-1])[::-1]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, places, 0))
    live = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(live):
        at = order[live]
        ahead = np.minimum(at + depth, n - 1)
        key = rank[at] * (n + 1) + np.where(next_break[at] < at + depth, at, rank[ahead])
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[live] = at
        fresh = np.ones(len(live), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        live = live[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit of the symbols per level, zeros before ones."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            zeros = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, zeros, n_zeros in self.levels:
            before = zeros[place]
            place = np.where(symbol >> bit & 1, n_zeros + place - before, before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._descend(symbol, place) - self.base[symbol]


class FmIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        """``symbols``: 1..sigma-1, 0 for breaks, one at the end."""
        order = suffix_order(symbols)
        self.last = symbols[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])[:sigma]
        self.wavelet = WaveletMatrix(self.last, sigma)
        # no step leads through a break, so the places after breaks are sampled too
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.size = len(symbols)

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.wavelet.rank(symbol, place)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, one a line, aligned to the right and filled up with 0 at the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            on = alive[symbol > 0]
            symbol = symbol[symbol > 0]
            low[on], high[on] = self.step(symbol, low[on]), self.step(symbol, high[on])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows, by steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            there = self.sampled[rows]
            out[todo[there]] = self.samples[self.sample_no[rows[there]]] + steps
            todo, rows = todo[~there], rows[~there]
            rows = self.step(self.last[rows], rows)
            steps += 1
        return out


class Windows:
    """Distinct windows of benchmark items, ready to be sent to tasks."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.window = window
        table = byte_table(ALNUM)
        table[table == 0] = 32
        found: dict[tuple, set] = {}
        for item, text in items:
            words = (text or "").encode().translate(table.tobytes()).split()
            if words and item is not None:
                size = min(window, len(words))
                for k in range(len(words) - size + 1):
                    found.setdefault(tuple(words[k: k + size]), set()).add(item)
        words = sorted({w for x in found for w in x})
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        hashes = word_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [words[k] for k in order]
        number = {w: k + 1 for k, w in enumerate(self.words)}
        self.patterns = np.zeros((len(found), window), np.int32)
        for row, x in enumerate(found):
            self.patterns[row, window - len(x):] = [number[w] for w in x]
        self.items = [sorted(x) for x in found.values()]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[int], list[int], list[int]]]:
        """(words, items, word spans, byte spans) of each text of a shard."""
        data = lowered(data, ALNUM)
        starts, ends, first = word_spans(data, offsets, ALNUM)
        numbers = np.zeros(len(starts), np.int32)
        if len(self.words) and len(starts):
            hashes = word_hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            numbers = np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)
        while True:
            place, pattern = self._occurrences(numbers, first)
            length = np.count_nonzero(self.patterns, axis=1)[pattern]
            edge = np.bincount(place, minlength=len(starts) + 1) - np.bincount(place + length, minlength=len(starts) + 1)
            # edges of overlapping windows: count how many cover each word
            hit = np.cumsum(edge)[:-1] > 0
            wrong = [k for k in np.flatnonzero(hit) if data[starts[k]: ends[k]].tobytes() != self.words[numbers[k] - 1]]
            if not wrong:
                break
            numbers[wrong] = 0  # another word with the same hash
        rows = len(offsets) - 1
        items: list[set] = [set() for _ in range(rows)]
        document = np.searchsorted(first, place, "right") - 1
        for row, k in set(zip(document.tolist(), pattern.tolist())):
            items[row].update(self.items[k])
        turns = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        # two spans that meet at the end of a text stay two
        inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hit))]
        inner = np.unique(inner[hit[inner - 1] & hit[inner]]) if len(inner) else inner
        begins = np.sort(np.concatenate([np.flatnonzero(turns == 1), inner]))
        lasts = np.sort(np.concatenate([np.flatnonzero(turns == -1), inner]))
        owner = np.searchsorted(first, begins, "right") - 1
        spans: list[tuple[list, list]] = [([], []) for _ in range(rows)]
        for row, begin, last in zip(owner.tolist(), begins.tolist(), lasts.tolist()):
            spans[row][0].extend((begin - int(first[row]), last - int(first[row])))
            spans[row][1].extend((int(starts[begin] - offsets[row]), int(ends[last - 1] - offsets[row])))
        counts = np.diff(first)
        return [(int(counts[k]), sorted(items[k]), *spans[k]) for k in range(rows)]

    def _occurrences(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of occurring windows and the windows' lines."""
        none = np.zeros(0, np.int64)
        known = numbers > 0
        if not len(self.patterns) or not known.any():
            return none, none
        # symbols: known words, and one break wherever other words or the end of a text come between them
        places = np.flatnonzero(known)
        text = np.searchsorted(first, places, "right")
        gap = np.ones(len(places), bool)
        gap[:-1] = (np.diff(places) > 1) | (np.diff(text) > 0)
        target = np.arange(len(places)) + np.concatenate([[0], np.cumsum(gap)[:-1]])
        symbols = np.zeros(int(target[-1]) + 2, np.int32)
        symbols[target] = numbers[places]
        word_of = np.zeros(len(symbols), np.int64)
        word_of[target] = places
        index = FmIndex(symbols, len(self.words) + 1)
        low, high = index.search(self.patterns)
        hits = np.flatnonzero(low < high)
        counts = (high - low)[hits]
        if not len(hits):
            return none, none
        pattern = np.repeat(hits, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hits], counts)
        return word_of[index.locate(rows)], pattern


def benchmark_blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[Windows]:
    """The windows in blocks of about ``limit`` bytes of text; a null item_id has none."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Windows([(x.item_id, x.text) for x in part.collect()], window)


def _merge(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of spans [begin, end, begin, end, ...]."""
    out: list[int] = []
    for begin, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Column]:
    """The rows of ``docs`` with one more column, and that column: a struct of n_words, n_hit, items, word_spans, byte_spans.

    ``items`` are the item_ids with a window in the text, in order; spans are pairs
    of first and past-the-last word or UTF-8 byte of what the occurring windows
    cover, merged. Null and word-less texts have 0 words and no spans; an item with
    fewer than ``window`` words is one window, one without words none; rows of the
    same item_id add up; rows with a null item_id are ignored. Repeated rows are
    judged each, an empty table gives no rows, other columns pass through whatever
    their names.
    """
    state = "hits"
    while state in docs.columns:
        state = f"_{state}"
    schema = f"struct<{', '.join(f'{k}: {v}' for k, v in FIELDS.items())}>"
    out = docs.withColumn(state, F.lit(None).cast(schema))
    for number, block in enumerate(benchmark_blocks(benchmark, window, block_bytes)):
        if number:
            out = settle(out, "decontaminate")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slabs(batches, column, SHARD_BYTES):
                at = batch.schema.get_field_index(state)
                before = batch.column(at).to_pylist()
                found = []
                for old, (n_words, items, words, places) in zip(before, shared.value.judge(*byte_column(batch.column(column)))):
                    if old:
                        items = sorted({*items, *old["items"]})
                        places, words = _merge_bytes(words, places, old), _merge(words, old["word_spans"])
                    found.append({"n_words": n_words, "n_hit": sum(words[1::2]) - sum(words[::2]), "items": items, "word_spans": words, "byte_spans": places})
                yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

        out = out.mapInArrow(run, out.schema)
    return out, F.col(state)


def _merge_bytes(words: list[int], places: list[int], old: dict) -> list[int]:
    """Byte spans of the union of two lists of word spans."""
    both = ((words, places), (old["word_spans"], old["byte_spans"]))
    begins = {w: b for x, y in both for w, b in zip(x[::2], y[::2])}
    lasts = {w: b for x, y in both for w, b in zip(x[1::2], y[1::2])}
    merged = _merge(words, old["word_spans"])
    return [z for begin, end in zip(merged[::2], merged[1::2]) for z in (begins[begin], lasts[end])]


def contaminated(hits: Column) -> Column:
    """At least a twentieth of a text's words lies in benchmark windows."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found, hits = find_windows(docs, benchmark)
    return found.where(~contaminated(hits)).select(*[F.col(f"`{x}`") for x in docs.columns])
