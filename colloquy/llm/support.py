"""What the operators share: the folder all executors see, Arrow slices, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLAB_BYTES = 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a session without that setting (tests) gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it again: computed once, and kept when executors go."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def byte_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's first position in them; null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = array.cast(pa.large_binary())
    _, places, data = wide.buffers()
    offsets = np.frombuffer(places, np.int64, len(wide) + 1 + wide.offset)[wide.offset:] if len(wide) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def slabs(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in a column; a longer text is a slice alone."""
    for batch in batches:
        _, offsets = byte_column(batch.column(column))
        begin, rows = 0, batch.num_rows
        while begin < rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(rows, max(end, begin + 1))
            yield batch.slice(begin, end - begin)
            begin = end


def byte_table(word: np.ndarray) -> np.ndarray:
    """256 entries: A-Z lower-cased where a byte belongs to words, 0 elsewhere."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return np.where(word, table, 0).astype(np.uint8)


def _all_but(*ranges: tuple[int, int]) -> np.ndarray:
    word = np.ones(256, bool)
    for low, high in ranges:
        word[low: high + 1] = False
    return word


#: words ``[^\x20\x09-\x0D]+``
SPACED = _all_but((0x20, 0x20), (0x09, 0x0D))
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing
ALNUM = _all_but((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word, and each row's first word (one more entry at the end)."""
    inside = word[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    lasts = heads[1:] - 1
    ends[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64)
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLAB_BYTES)
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64))):
            _powers[k] = np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums whose differences are the hashes of byte ranges; see ``range_hashes``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power_tables(len(data))[0], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes have equal hashes wherever they stand."""
    inverse = _power_tables(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_hashes(data), starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, by the place of its first word."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(_MULTIPLIER) + words[k: k + n]
    return mix(total)


def lowered(data: np.ndarray, word: np.ndarray) -> np.ndarray:
    return byte_table(word)[data]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def vector_sum(frame: DataFrame, fold, size: int, kind: str = "<f8", block: int = 1024) -> np.ndarray:
    """Sum over all tasks of the vector of ``size`` numbers that ``fold(batches)`` gives for a task's rows.

    The size is fixed before, so what comes to the driver is bounded. Vectors travel in
    blocks, each added up by one task as they come; ``fold`` returns None for no rows.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fold(batches)
        if total is not None:
            total = np.ascontiguousarray(total, kind)
            used = [k for k in range(0, size, block) if total[k: k + block].any()]
            for at in range(0, len(used), 64):
                part = used[at: at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k // block for k in part], pa.int32()), pa.array([total[k: k + block].tobytes() for k in part], pa.binary())],
                    names=["block", "numbers"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(numbers, kind)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "numbers"])

    shape = "block int, numbers binary"
    total = np.zeros(size, kind)
    for row in frame.mapInArrow(cut, shape).repartition("block").mapInArrow(add, shape).collect():
        part = np.frombuffer(row.numbers, kind)
        total[row.block * block: row.block * block + len(part)] = part
    return total
