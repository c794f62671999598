"""Packing token sequences into fixed windows by minimum bin slack.

Lengths of what is still unpacked are kept as a multiset. For each window a bitset
says which totals its lengths reach (one shift and one "or" per binary share of a
count); the largest reachable total up to the capacity is traced back to counts per
length. What slack remains is closed by cutting one more document, so every window
but the last few of a task is exactly full.

Windows are filled inside tasks from a bounded pool, so nothing is shuffled and a
rerun task packs the same windows under the same ids.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from colloquy.llm.support import slabs
from colloquy.llm.tokens import codec

CAPACITY = 4096
POOL = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def closest_fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length whose total is the largest not above the capacity.

    ``lengths`` maps a length to how many items have it. An empty multiset, or one
    with longer items only, gives no counts.
    """
    reach, steps, full = 1, [], 1 << capacity
    limit = (full << 1) - 1
    for length in sorted(lengths, reverse=True):
        left, share = lengths[length] if 0 < length <= capacity else 0, 1
        while left > 0 and not reach & full:
            share = min(share, left)
            if length * share > capacity:
                break
            steps.append((reach, length, share))
            reach |= (reach << (length * share)) & limit
            left -= share
            share *= 2
        if reach & full:
            break
    total, counts = reach.bit_length() - 1, defaultdict(int)
    for before, length, share in reversed(steps):
        if not before >> total & 1:
            counts[length] += share
            total -= length * share
    return dict(counts)


class Packer:
    """Fills windows from items (doc_id, start, ids, doc_tokens) of one task, four bytes an id."""

    def __init__(self, capacity: int, pool: int, first_id: int):
        self.capacity, self.pool = capacity, pool
        self.items: dict[int, list] = defaultdict(list)
        self.waiting, self.tokens, self.next_id = 0, 0, first_id
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, begin, step = len(ids) // 4, 0, self.capacity
        while total - begin >= step:
            self._place([(doc_id, begin, ids[4 * begin: 4 * (begin + step)], total)])
            begin += step
        if begin < total:
            self._keep((doc_id, begin, ids[4 * begin:], total))
        if self.waiting >= self.pool:
            while self.waiting > self.pool // 4 and self.tokens >= self.capacity:
                self._place(self._window())

    def finish(self) -> None:
        """Pack what is left; the last lengths go to windows of a power of two, which need no padding."""
        while self.tokens >= self.capacity:
            self._place(self._window())
        left = self.tokens
        rest = [x for length in sorted(self.items, reverse=True) for x in self.items[length]]
        self.items.clear()
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                item = rest.pop(0)
                if len(item[2]) // 4 > room:
                    item, tail = self._cut(item, room)
                    rest.insert(0, tail)
                window.append(item)
                room -= len(item[2]) // 4
            self._place(window)

    def _keep(self, item: tuple) -> None:
        self.items[len(item[2]) // 4].append(item)
        self.waiting += 1
        self.tokens += len(item[2]) // 4

    @staticmethod
    def _cut(item: tuple, length: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total = item
        return (doc_id, start, ids[: 4 * length], total), (doc_id, start + length, ids[4 * length:], total)

    def _take(self, length: int) -> tuple:
        items = self.items[length]
        item = items.pop()
        if not items:
            del self.items[length]
        self.waiting -= 1
        self.tokens -= length
        return item

    def _window(self) -> list[tuple]:
        """The longest item and the multiset that comes closest to filling the rest; a cut closes the slack."""
        window = [self._take(max(self.items))]
        room = self.capacity - len(window[0][2]) // 4
        for length, count in closest_fill({k: len(v) for k, v in self.items.items()}, room).items():
            window += [self._take(length) for _ in range(count)]
            room -= length * count
        if room and self.items:
            # every item left is longer than the slack, or it would have been taken
            piece, tail = self._cut(self._take(min(self.items)), room)
            window.append(piece)
            self._keep(tail)
        return window

    def _place(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.out.append((doc_id, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1


def pack_ids(encoded: DataFrame, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """Pieces of sequences (doc_id, ids binary) in windows of ``capacity`` ids.

    Every id lies in exactly one piece; ids are little-endian unsigned 32-bit. Rows
    with null or empty ids give no piece, a null doc_id is carried through, repeated
    rows are packed as often as they come, an empty table gives no rows. A window's
    id is the task's number times 2**40 and its place in the task. Windows are full
    but for the last of a task, whose lengths are powers of two.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(((batch.column(0).to_pylist(), batch.column(1).to_pylist()) for batch in slabs(batches, "ids")), capacity, pool)

    return encoded.select("doc_id", "ids").mapInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """Tokenize whole texts, end each with ``end_id`` and pack them; null text counts as empty.

    Columns besides doc_id and text are ignored; see ``pack_ids`` for the rest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")

        def rows():
            for batch in slabs(batches, "text"):
                texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
                yield batch.column(0).to_pylist(), [x + end for x in codec(tokenizer).encode(texts)]

        yield from _packed(rows(), capacity, pool)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _packed(rows, capacity: int, pool: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(capacity, pool, TaskContext.get().partitionId() << 40)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def flush():
        out, packer.out = packer.out, []
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    for ids, texts in rows:
        for doc_id, text in zip(ids, texts):
            packer.add(doc_id, text or b"")
        if packer.out:
            yield flush()
    packer.finish()
    if packer.out:
        yield flush()
