"""Runs of words that repeat with one period, by internal pattern matching.

A run of at least four periods holds a whole dyadic block (``2**k`` words from a
multiple of ``2**k`` on) that is longer than the period and occurs again one period
before or behind it. So every block that occurs more than once asks for its nearest
occurrences in the two neighbouring windows of its own length: its occurrences are one
interval of the suffix order, and a wavelet tree over that order gives the range
successor and predecessor of the block's place. Occurrences that overlap stand in
arithmetic progression, so the nearest one has the only step that can be a period
longer than half a block; what lies between is a stretch with that period. Stretches of
one period that overlap by it are one, are lengthened to both sides word by word, and
of equal stretches the one with the smallest period is a run.

All texts of a slice of a task are handled at once; a text is never cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import slabs

SHORTEST = 6
REPEATS = 4
#: words compared at a time when a stretch is lengthened
STRIDE = 32
FIELDS = "n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string"


def _groups(key: np.ndarray) -> np.ndarray:
    """Where a sorted key differs from the one before."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return fresh


def dyadic_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each the largest k whose first 2**k symbols it shares with the one before (-1: none).

    The last symbol must occur once. Ranks of 2**k symbols give those of twice as many;
    suffixes that are told apart take no further part.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = _groups(symbols[order])
    level = np.where(fresh, -1, 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    live = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    size, k = 1, 0
    while len(live):
        at, k = order[live], k + 1
        # equal windows hold no symbol that occurs once, so something follows them
        key = rank[at] * n + rank[at + size]
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[live] = at
        fresh = _groups(key)
        level[live[~fresh]] = k
        rank[at] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        live = live[~(fresh & np.append(fresh[1:], True))]
        size *= 2
    return order, level


class PlaceTree:
    """Wavelet tree of a sequence of places: how many of a range are smaller, and the k-th smallest of a range."""

    def __init__(self, places: np.ndarray):
        self.levels = []
        for bit in range(max(1, (len(places) - 1).bit_length()) - 1, -1, -1):
            ones = (places >> bit & 1).astype(bool)
            zeros = np.zeros(len(places) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            places = np.concatenate([places[~ones], places[ones]])

    def smaller(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        total = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = (value >> bit & 1).astype(bool)
            total += np.where(one, b - a, 0)
            low, high = np.where(one, n_zeros + low - a, a), np.where(one, n_zeros + high - b, b)
        return total

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros(len(low), np.int64)
        for bit, zeros, n_zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, n_zeros + low - a, a), np.where(one, n_zeros + high - b, b)
        return value


def block_periods(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, period) of the stretches between a dyadic block and its nearest occurrence on either side."""
    order, level = dyadic_order(symbols)
    n = len(symbols)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    asked = []
    for k in range(1, int(level.max(initial=0)) + 1):
        size = 1 << k
        start = np.arange(0, n - size, size)
        borders = np.append(np.flatnonzero(level < k), n)
        group = np.searchsorted(borders, rank[start], "right") - 1
        low, high = borders[group], borders[group + 1]
        often = high - low > 1
        asked.append((start[often], np.full(int(often.sum()), size), low[often], high[often]))
    if not sum(len(x[0]) for x in asked):
        none = np.zeros(0, np.int64)
        return none, none, none
    start, size, low, high = (np.concatenate(x) for x in zip(*asked))
    tree = PlaceTree(order)
    before = tree.smaller(low, high, start)
    found = []
    for step in (1, -1):
        some = np.flatnonzero((before + step >= 0) & (before + step < high - low))
        place = tree.smallest(low[some], high[some], before[some] + step)
        near = np.abs(place - start[some]) <= size[some]
        some, place = some[near], place[near]
        first = np.minimum(place, start[some])
        period = np.abs(place - start[some])
        found.append((first, first + period + size[some], period))
    return tuple(np.concatenate(x) for x in zip(*found))


def _joined(first: np.ndarray, end: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap by the period are one."""
    turn = np.lexsort((first, period))
    first, end, period = first[turn], end[turn], period[turn]
    shift = period * (n + 1)  # keeps the periods apart in one running maximum
    reach = np.maximum.accumulate(end + shift) - shift
    new = np.ones(len(first), bool)
    new[1:] = (period[1:] != period[:-1]) | (first[1:] + period[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    lasts = np.append(heads, len(first))[1:] - 1
    return first[heads], reach[lasts], period[heads]


def _further(symbols: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from ``at`` on in a direction equal those a period back; the ends of ``symbols`` occur once."""
    more, todo, n = np.zeros(len(at), np.int64), np.arange(len(at)), len(symbols)
    reach = step * np.arange(STRIDE)
    while len(todo):
        here = np.clip((at[todo] + step * more[todo])[:, None] + reach, 0, n - 1)
        there = np.clip(here - step * period[todo, None], 0, n - 1)
        same = symbols[here] == symbols[there]
        run = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
        more[todo] += run
        todo = todo[run == STRIDE]
    return more


def runs(symbols: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, smallest period) of all maximal stretches of at least ``shortest`` symbols and ``repeats`` (four or more) periods.

    The first and the last symbol must occur once.
    """
    if repeats < REPEATS or shortest < 3:
        raise ValueError("blocks are sure to meet runs of four periods and three words")
    first, end, period = _joined(*block_periods(symbols), len(symbols))
    first = first - _further(symbols, first - 1, period, -1)
    end = end + _further(symbols, end, period, 1)
    long = end - first >= np.maximum(shortest, repeats * period)
    turn = np.lexsort((period[long], end[long], first[long]))
    first, end, period = first[long][turn], end[long][turn], period[long][turn]
    # a stretch with a multiple of its smallest period is the same stretch
    fresh = _groups(first * (len(symbols) + 1) + end)
    return first[fresh], end[fresh], period[fresh]


def text_runs(texts: list[bytes | None], shortest: int, repeats: int) -> list[dict]:
    """``FIELDS`` of each text."""
    words = [(x or b"").split() for x in texts]
    numbers: defaultdict[bytes, int] = defaultdict(count(len(words) + 1).__next__)
    # each text between symbols of its own; words have the numbers after those
    offsets = np.cumsum([0] + [len(x) + 1 for x in words])
    symbols = np.zeros(int(offsets[-1]) + 1, np.int64)
    symbols[offsets] = np.arange(len(offsets))
    for at, x in zip(offsets.tolist(), words):
        symbols[at + 1: at + 1 + len(x)] = [numbers[w] for w in x]
    first, end, period = runs(symbols, shortest, repeats)
    order = np.lexsort((period, first))
    first, end, period = first[order], end[order], period[order]
    bounds = np.searchsorted(first, offsets)
    out = []
    for row, x in enumerate(words):
        found, kept = [], x
        if bounds[row] < bounds[row + 1]:
            mine = slice(bounds[row], bounds[row + 1])
            begin = first[mine] - offsets[row] - 1
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, begin + period[mine], 1)
            np.add.at(edge, begin + end[mine] - first[mine], -1)
            kept = [x[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            found = [{"start": a, "length": b, "period": c} for a, b, c in zip(begin.tolist(), (end - first)[mine].tolist(), period[mine].tolist())]
        out.append({"n_words": len(x), "runs": found, "collapsed": b" ".join(kept)})
    return out


def find_runs(docs: DataFrame, column: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> tuple[DataFrame, Column]:
    """The rows of ``docs`` with one more column, and that column: a struct of n_words, runs and collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, as they stand. ``runs`` are (start, length,
    period) in words, by start, then period: maximal stretches of at least ``shortest``
    words and ``repeats`` times their smallest period. ``collapsed`` joins by one space
    the words that are left when each run keeps its first period only. Null, empty and
    blank texts have no words, no runs and an empty collapsed text; repeated rows are
    judged each, an empty table gives no rows, other columns pass through whatever their
    names. A text is held in memory whole, with some 250 bytes a word.
    """
    state = "periods"
    while state in docs.columns:
        state = f"_{state}"
    out = docs.withColumn(state, F.lit(None).cast(f"struct<{FIELDS}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, column):
            at = batch.schema.get_field_index(state)
            kind = batch.schema.field(at)
            found = text_runs(batch.column(column).cast(pa.large_binary()).to_pylist(), shortest, repeats)
            yield batch.set_column(at, kind, pa.array(found, kind.type))

    return out.mapInArrow(run, out.schema), F.col(state)


def longest(found: Column) -> Column:
    """Of runs the longest, then the first, then that with the smallest period; null for none."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))
