"""Quality classifier by co-training of two views.

One view sees the words of a text, the other the document's metadata (source,
language, length). Both are naive Bayes models, so fitting them is a sum over
documents: the first counts come from labelled documents, and in each round every
unlabelled document that one view is sure of adds to the other view's counts. Scores
are turned to probabilities on labelled documents that no counts came from; at the
end both views' log-odds add up, less the prior they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import SPACED, byte_column, lowered, mix, settle, slabs, vector_sum, word_hashes, word_spans

#: labelled documents that take part, half for counts and half for calibration
SAMPLE_DOCUMENTS = 20_000
ROUNDS = 2
SURE = 0.95
#: least probability of good quality
ACCEPT = 0.5
#: words that a short text is filled up with, which speak for neither class
SHORT = 10
WORDS, SHAPES, META = 1 << 15, 1 << 8, 1 << 12
BINS, REACH = 512, 8.0
NUMBERS = 2 * (WORDS + SHAPES + META) + 4
FIELDS = {"text_score": "double", "meta_score": "double", "text_probability": "double", "meta_probability": "double", "probability": "double"}


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _kind(marks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(marks, np.uint8)] = True
    return out


_UPPER, _LOWER, _DIGIT = _kind(bytes(range(65, 91))), _kind(bytes(range(97, 123))), _kind(bytes(range(48, 58)))
_SYMBOL, _SHOUT = _kind(b"#*$%&|<>{}[]\\^~@="), _kind(b"!?")


def text_view(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: hashed word and shape; and each text's first word."""
    starts, ends, first = word_spans(data, offsets, SPACED)
    hashes = word_hashes(lowered(data, SPACED), starts, ends)
    upper, lower, digit, symbol, shout = (_running(x[data]) for x in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _SHOUT))
    has = lambda x: x[ends] > x[starts]
    echo = np.zeros(len(hashes), bool)
    for k in (1, 2):
        echo[k:] |= hashes[k:] == hashes[:-k]
    size = ends - starts
    bits = [has(upper), has(upper) & ~has(lower) & (size > 1), has(digit), has(symbol), has(shout), echo, size > 4, size > 14]
    shape = sum(x.astype(np.int64) << k for k, x in enumerate(bits))
    return (hashes & np.uint64(WORDS - 1)).astype(np.int64), shape, first


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed metadata of each document: source, language, length, and language with length. Null is a value of its own."""
    n = batch.num_rows
    whole = []
    for name in ("source", "lang"):
        data, offsets = byte_column(batch.column(name).cast(pa.string()))
        hashes = word_hashes(data, offsets[:-1], offsets[1:])
        whole.append(np.where(np.array(batch.column(name).is_valid()), hashes, np.uint64(7)))
    chars = pc.fill_null(batch.column("n_chars").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    length = np.where(chars > 0, np.log2(np.maximum(chars, 1)) * 2, chars).astype(np.int64).astype(np.uint64)
    views = [whole[0], whole[1], length, mix(whole[1]) + length]
    seeded = [mix(x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k, x in enumerate(views)]
    return np.stack([(x & np.uint64(META - 1)).astype(np.int64) for x in seeded], axis=1) if n else np.zeros((0, 4), np.int64)


@dataclass
class Model:
    """Log-odds of good against bad per word, shape and metadata value, and calibration lines (slope, shift)."""

    words: np.ndarray
    shapes: np.ndarray
    meta: np.ndarray
    prior: float
    text_line: tuple[float, float] = (1.0, 0.0)
    meta_line: tuple[float, float] = (1.0, 0.0)

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple]:
        words, shapes, first = text_view(*byte_column(batch.column("text")))
        sums = np.zeros(len(words) + 1)
        np.cumsum(self.words[words] + self.shapes[shapes], out=sums[1:])
        text = np.diff(sums[first]) / (np.diff(first) + SHORT)
        meta_words = meta_view(batch)
        return np.clip(text, -REACH, REACH), np.clip(self.meta[meta_words].sum(axis=1), -REACH, REACH), (words, shapes, first, meta_words)

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (line[0] * x + line[1] for line, x in ((self.text_line, text), (self.meta_line, meta)))
        return tuple(1 / (1 + np.exp(-x)) for x in (a, b, a + b - self.prior))


def _split(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, rest = numbers[: 2 * WORDS].reshape(2, WORDS), numbers[2 * WORDS:]
    shapes, rest = rest[: 2 * SHAPES].reshape(2, SHAPES), rest[2 * SHAPES:]
    return words, shapes, rest[: 2 * META].reshape(2, META), rest[2 * META:]


def _add(numbers: np.ndarray, seen: tuple, text_class: np.ndarray, meta_class: np.ndarray) -> None:
    """Add documents to the counts; class 1 is good, 0 bad, -1 for none."""
    words, shapes, first, meta = seen
    w, s, m, documents = _split(numbers)
    of_word = np.repeat(text_class, np.diff(first))
    for k in (0, 1):
        w[k] += np.bincount(words[of_word == k], minlength=WORDS)
        s[k] += np.bincount(shapes[of_word == k], minlength=SHAPES)
        m[k] += np.bincount(meta[meta_class == k].ravel(), minlength=META)
        documents[k] += (text_class == k).sum()
        documents[2 + k] += (meta_class == k).sum()


def _model(numbers: np.ndarray, prior: float) -> Model:
    def odds(counts: np.ndarray, smoothing: float) -> np.ndarray:
        share = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])
        return np.log(share[1]) - np.log(share[0])

    words, shapes, meta, _ = _split(numbers)
    return Model(odds(words, 1.0), odds(shapes, 0.1), odds(meta, 1.0), prior)


def _line(histogram: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic line through scores of labelled documents, by Newton steps with a small penalty."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    n, good = histogram.sum(axis=0), histogram[1]
    if not n.sum():
        return 1.0, prior
    rows = np.stack([x, np.ones(BINS)], axis=1)
    line, penalty = np.array([0.0, prior]), np.array([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ line, -30, 30)))
        gradient = rows.T @ (good - n * p) - penalty * line
        curve = (rows * (n * p * (1 - p))[:, None]).T @ rows + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        line += np.clip(step, -2, 2)
    return float(max(line[0], 0.0)), float(line[1])


def _columns(docs: DataFrame) -> list[Column]:
    """doc_id, text and the metadata columns; one that the table lacks is null throughout."""
    return [F.col(f"`{x}`") if x in docs.columns else F.lit(None).cast("string").alias(x) for x in ("doc_id", "text", "source", "lang", "n_chars")]


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sample: int = SAMPLE_DOCUMENTS, sure: float = SURE) -> Model:
    """Co-train both views on ``docs``, with at most ``sample`` labelled documents (doc_id, quality 0 or 1).

    Rows of ``labels`` with a null are ignored; labels of one kind only, or none, give
    a model that accepts everything.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    wide = docs.select(*_columns(docs))
    kept = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")
    labelled = settle(wide.join(F.broadcast(chosen), "doc_id").withColumn("calibrates", kept), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        numbers = np.zeros(NUMBERS)
        plain = Model(np.zeros(WORDS), np.zeros(SHAPES), np.zeros(META), 0.0)
        for batch in slabs(batches, "text"):
            quality = np.where(batch.column("calibrates").to_numpy() == 0, batch.column("quality").to_numpy(), -1)
            _add(numbers, plain.scores(batch)[2], quality, quality)
        return numbers

    base = vector_sum(labelled, count, NUMBERS)
    bad, good = _split(base)[3][:2]
    prior = float(np.log((good + 1) / (bad + 1)))
    if not bad or not good:
        return Model(np.zeros(WORDS), np.zeros(SHAPES), np.zeros(META), prior, (0.0, 20.0), (0.0, prior))
    known = np.array(sorted(x.doc_id for x in chosen.select("doc_id").collect()))

    def calibrated(model: Model) -> Model:
        def histogram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            bins = np.zeros((2, 2, BINS))
            for batch in slabs(batches, "text"):
                held = batch.column("calibrates").to_numpy() == 1
                quality = batch.column("quality").to_numpy()[held]
                for view, score in enumerate(model.scores(batch)[:2]):
                    at = np.minimum(((score[held] + REACH) / (2 * REACH) * BINS).astype(np.int64), BINS - 1)
                    np.add.at(bins[view], (quality, at), 1)
            return bins.ravel()

        bins = vector_sum(labelled, histogram, 4 * BINS).reshape(2, 2, BINS)
        model.text_line, model.meta_line = (_line(x, prior) for x in bins)
        return model

    model = calibrated(_model(base, prior))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((model, known))

        def exchange(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
            now, taken = shared.value
            numbers = np.zeros(NUMBERS)
            for batch in slabs(batches, "text"):
                text, meta, seen = now.scores(batch)
                by_text, by_meta, _ = now.probabilities(text, meta)
                free = ~np.isin(pc.fill_null(batch.column("doc_id"), -1).to_numpy(zero_copy_only=False), taken) & (np.diff(seen[2]) > 0)
                teach = [np.where(free & (p >= sure), 1, np.where(free & (p <= 1 - sure), 0, -1)) for p in (by_text, by_meta)]
                # each view learns what the other is sure of, unless both are and differ
                differ = (teach[0] >= 0) & (teach[1] >= 0) & (teach[0] != teach[1])
                _add(numbers, seen, np.where(differ, -1, teach[1]), np.where(differ, -1, teach[0]))
            return numbers

        model = calibrated(_model(base + vector_sum(wide, exchange, NUMBERS), prior))
        shared.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> tuple[DataFrame, Column]:
    """The rows of ``docs`` with one more column, and that column: a struct of ``FIELDS``.

    Null and empty texts have text score 0; null metadata is a value of its own, and a
    metadata column that the table lacks counts as null. Repeated rows are scored each,
    an empty table gives no rows, other columns pass through whatever their names.
    """
    name = "quality"
    while name in docs.columns:
        name = f"_{name}"
    schema = f"struct<{', '.join(f'{k}: {v}' for k, v in FIELDS.items())}>"
    wide = docs.withColumn(name, F.lit(None).cast(schema))
    missing = [x for x in ("source", "lang", "n_chars") if x not in docs.columns]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            full = batch
            for x in missing:
                full = full.append_column(x, pa.nulls(batch.num_rows, pa.string()))
            text, meta, _ = shared.value.scores(full)
            values = [pa.array(x, pa.float64()) for x in (text, meta, *shared.value.probabilities(text, meta))]
            at = batch.schema.get_field_index(name)
            yield batch.set_column(at, batch.schema.field(at), pa.StructArray.from_arrays(values, fields=list(batch.schema.field(at).type)))

    return wide.mapInArrow(run, wide.schema), F.col(name)


def accepted(quality: Column, least: float = ACCEPT) -> Column:
    return quality["probability"] >= least


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    scored, quality = score(docs, train(docs, labels))
    return scored.where(accepted(quality)).select(*[F.col(f"`{x}`") for x in docs.columns])
