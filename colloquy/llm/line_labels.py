"""Quality rules: counts per text, and a linear-chain conditional random field over its lines.

Every line with a word gets features of its own; the field labels the lines of a text
as content or boilerplate by Viterbi decoding, and the share of words in content
lines decides. The field is fitted by gradient steps on the conditional likelihood,
on lines of a bounded sample of labelled documents: lines of good documents count as
content, repeats apart, lines of bad ones as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import SPACED, byte_column, mix, prefix_hashes, range_hashes, slabs, window_hashes, word_spans

REPEAT_WINDOW = 8
#: labelled documents that the field is fitted on
SAMPLE_DOCUMENTS = 4000
#: least share of words in content lines
CONTENT_SHARE = 0.3
SEGMENT = 64
FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long",
    "content_words": "long", "line_labels": "binary",
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?:;,\"')", np.uint8)] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[np.frombuffer(b"!?", np.uint8)] = True
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


@dataclass
class Lines:
    """The lines with a word of a shard: first line of each text, words before each line's end, features."""

    first: np.ndarray
    words: np.ndarray
    features: np.ndarray


def _steps(share: np.ndarray, *edges: float) -> list[np.ndarray]:
    return [share > x for x in edges]


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], Lines]:
    """Counts of each text of a shard, and its lines."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, SPACED)
    sums = prefix_hashes(data)
    words = range_hashes(sums, starts, ends)
    inside = SPACED[data]
    chars, symbols = _running(inside & _STARTS_CHARACTER[data]), _running(_SYMBOL[data])
    # windows of words that lie in one text and occur there twice or more
    at = np.arange(max(0, len(words) - REPEAT_WINDOW + 1))
    owner = np.searchsorted(first, at, "right") - 1
    fits = at + REPEAT_WINDOW <= first[owner + 1] if len(at) else np.zeros(0, bool)
    at, owner = at[fits], owner[fits]
    key = mix(window_hashes(words, REPEAT_WINDOW)[at] + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    fresh = np.append(True, np.diff(key[order]) != 0)[: len(order)]
    again = at[order[~(fresh & np.append(fresh[1:], True)[: len(order)])]]
    edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + REPEAT_WINDOW, minlength=len(words) + 1)
    repeated = _running(np.cumsum(edge)[:-1] > 0)
    # lines: between line feeds and ends of texts
    cuts = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], cuts + 1])) if rows else np.zeros(0, np.int64)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    # the feed itself belongs to no line
    line_ends = line_ends - ((line_ends > line_starts) & (data[np.maximum(line_ends, 1) - 1] == 10)) if len(line_starts) else line_ends
    low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = high > low
    line_starts, line_ends, low, high = line_starts[full], line_ends[full], low[full], high[full]
    text = np.searchsorted(offsets, line_starts, "right") - 1
    line_first = np.searchsorted(line_starts, offsets)
    line_first[-1] = len(line_starts)
    key = mix(range_hashes(sums, line_starts, line_ends) + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = np.append(False, np.diff(key[order]) == 0)[: len(order)]
    duplicate = np.zeros(len(order), bool)
    duplicate[order[same]] = True
    counts = {
        "n_words": np.diff(first), "word_chars": np.diff(chars[offsets]), "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": np.diff(_running(duplicate)[line_first]), "n_repeat_words": np.diff(repeated[first]), "n_lines": np.diff(line_first),
    }
    size = np.maximum(1, chars[line_ends] - chars[line_starts])
    n = high - low
    letters = _running(_LOWER[data])
    upper, digits, shouts = _running(_UPPER[data]), _running(_DIGIT[data]), _running(_SHOUT[data])
    capitals = (upper[line_ends] - upper[line_starts]) / np.maximum(1, upper[line_ends] - upper[line_starts] + letters[line_ends] - letters[line_starts])
    # a word equal to one of the two words before it
    echo = np.zeros(len(words) + 1, np.int64)
    near = np.zeros(len(words), bool)
    for k in (1, 2):
        near[k:] |= words[k:] == words[:-k]
    np.cumsum(near, out=echo[1:])
    features = np.stack([
        np.ones(len(n), bool), n <= 2, n <= 5, n > 12, *_steps((symbols[line_ends] - symbols[line_starts]) / size, 0.02, 0.08, 0.2),
        *_steps(capitals, 0.3, 0.7), *_steps((digits[line_ends] - digits[line_starts]) / size, 0.1, 0.3),
        *_steps((shouts[line_ends] - shouts[line_starts]) / n, 0.2, 0.6), *_steps((echo[high] - echo[low]) / n, 0.2, 0.5),
        *_steps((repeated[high] - repeated[low]) / n, 0.3, 0.7), duplicate, _STOP[data[ends[high - 1] - 1]], size / n > 12, size / n < 3,
    ], axis=1).astype(np.float32) if len(n) else np.zeros((0, WIDTH), np.float32)
    return counts, Lines(line_first, n, features)


WIDTH = 21
#: weights of a field without labelled lines: symbols, shouting, echoes and repeats speak against content
PRIOR = np.array([-2, 0.3, 0.2, -0.3, 1, 1, 1, 0.5, 1.5, 0.5, 0.5, 1, 1.5, 1, 1.5, 0.5, 1, 0.5, -0.5, 0.2, 0.2, 0, 0, 0], np.float64)


@dataclass
class Field:
    """Log-odds of boilerplate per feature, and gains of a change of label and of equal neighbours."""

    weights: np.ndarray
    transitions: np.ndarray

    def decode(self, lines: Lines) -> np.ndarray:
        """Best label of every line, 1 for boilerplate, text by text; ties go to content."""
        score = lines.features @ self.weights
        counts = np.diff(lines.first)
        order = np.argsort(-counts, kind="stable")
        begin, counts = lines.first[:-1][order], counts[order]
        labels = np.zeros(len(score), np.int8)
        if not len(score):
            return labels
        back = np.zeros((len(score), 2), np.int8)
        alive = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right")
        best = np.stack([np.zeros(alive[0]), score[begin[: alive[0]]]], axis=1)
        for t in range(1, counts[0]):
            now = begin[: alive[t]] + t
            paths = best[: alive[t], :, None] + self.transitions[None]
            choice = paths[:, 1] > paths[:, 0]
            back[now] = choice
            best[: alive[t]] = np.where(choice, paths[:, 1], paths[:, 0])
            best[: alive[t], 1] += score[now]
        state = (best[:, 1] > best[:, 0]).astype(np.int8)
        for t in range(counts[0] - 1, -1, -1):
            now = begin[: alive[t]] + t
            labels[now] = state[: alive[t]]
            state[: alive[t]] = back[now, state[: alive[t]]]
        return labels


def default_field() -> Field:
    return Field(PRIOR[:WIDTH], np.array([[0.5, -0.5], [-0.5, 0.5]]))


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Conditional likelihood by gradient steps with momentum; sequences are (features, labels) of neighbouring lines.

    Long sequences are cut every ``SEGMENT`` lines. Without any sequence, or with one
    label only, the field keeps its prior weights.
    """
    parts = [(x[k: k + SEGMENT], y[k: k + SEGMENT]) for x, y in sequences for k in range(0, len(y), SEGMENT)]
    field = default_field()
    if not parts or len({int(v) for _, y in parts for v in np.unique(y)}) < 2:
        return field
    n, longest = len(parts), max(len(y) for _, y in parts)
    features, labels, mask = np.zeros((n, longest, WIDTH), np.float32), np.zeros((n, longest), np.int64), np.zeros((n, longest))
    for k, (x, y) in enumerate(parts):
        features[k, : len(y)], labels[k, : len(y)], mask[k, : len(y)] = x, y, 1
    pairs = mask[:, 1:] * mask[:, :-1]
    total = mask.sum()
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), pairs.ravel())
    weights, transitions = field.weights.copy(), field.transitions.copy()
    speed_w, speed_t = np.zeros(WIDTH), np.zeros((2, 2))
    for _ in range(steps):
        emission = np.stack([np.zeros((n, longest)), features @ weights], axis=2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emission[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + transitions, axis=1) + emission[:, t]
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(transitions + (emission[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = step * mask[:, t + 1, None]
        share = forward + backward
        share = np.exp(share - np.logaddexp.reduce(share, axis=2)[:, :, None])
        joint = forward[:, :-1, :, None] + transitions + (emission[:, 1:] + backward[:, 1:])[:, :, None, :]
        joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(n, longest - 1, 4), axis=2)[:, :, None, None]) if longest > 1 else joint
        gradient_w = np.einsum("ntf,nt->f", features, (labels - share[:, :, 1]) * mask) / total - decay * (weights - PRIOR[:WIDTH])
        gradient_t = (seen - (joint * pairs[:, :, None, None]).sum(axis=(0, 1))) / total - decay * transitions
        speed_w, speed_t = 0.9 * speed_w + rate * gradient_w, 0.9 * speed_t + rate * gradient_t
        weights, transitions = weights + speed_w, transitions + speed_t
    return Field(weights, transitions)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, quality) of at most ``size`` labelled documents, chosen by a hash of doc_id."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "quality").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Field:
    """A field from lines of labelled documents, at most ``sample`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            counts, lines = measure(*byte_column(batch.column("text")))
            kept = [np.packbits(lines.features[a:b].astype(bool), axis=1).tobytes() for a, b in zip(lines.first[:-1], lines.first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), batch.column("quality").cast(pa.int32())], names=["features", "quality"])

    sequences = []
    for row in labelled_sample(docs, labels, sample).mapInArrow(run, "features binary, quality int").collect():
        bits = np.frombuffer(row.features, np.uint8).reshape(-1, (WIDTH + 7) // 8)
        features = np.unpackbits(bits, axis=1)[:, :WIDTH].astype(np.float32)
        # a line that repeats an earlier one is boilerplate in good documents too
        labels_of = features[:, DUPLICATE].astype(int) if row.quality else np.ones(len(features), int)
        if len(features):
            sequences.append((features, labels_of))
    return fit_field(sequences)


DUPLICATE = 17


def judge_lines(docs: DataFrame, field: Field, column: str = "text") -> tuple[DataFrame, Column]:
    """The rows of ``docs`` with one more column, and that column: a struct of ``FIELDS``.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word, equal to an earlier one), n_repeat_words (words in 8-word windows that the
    text has twice or more), n_lines (lines with a word), content_words (words in
    content lines) and line_labels (a byte per line with a word, 1 for boilerplate).
    Null and word-less texts have zeros and no lines; repeated rows are judged each, an
    empty table gives no rows, other columns pass through whatever their names.
    """
    name = "lines"
    while name in docs.columns:
        name = f"_{name}"
    schema = f"struct<{', '.join(f'{k}: {v}' for k, v in FIELDS.items())}>"
    wide = docs.withColumn(name, F.lit(None).cast(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, column):
            counts, lines = measure(*byte_column(batch.column(column)))
            labels = field.decode(lines)
            content = _running(lines.words * (labels == 0))
            counts["content_words"] = np.diff(content[lines.first])
            marks = labels.astype(np.uint8).tobytes()
            values = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
            values["line_labels"] = pa.array([marks[a:b] for a, b in zip(lines.first[:-1], lines.first[1:])], pa.binary())
            at = batch.schema.get_field_index(name)
            kind = batch.schema.field(at).type
            yield batch.set_column(at, batch.schema.field(at), pa.StructArray.from_arrays([values[k] for k in FIELDS], fields=list(kind)))

    return wide.mapInArrow(run, wide.schema), F.col(name)


def base_failed(lines: Column) -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (lines["n_words"] < 20) | (100 * lines["n_repeat_words"] > 30 * lines["n_words"])


def kept(lines: Column, share: float = CONTENT_SHARE) -> Column:
    """The base rules hold and enough words lie in content lines."""
    return ~base_failed(lines) & (lines["content_words"] >= share * lines["n_words"])


def keep_content(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    judged, lines = judge_lines(docs, train(docs, labels))
    return judged.where(kept(lines)).select(*[F.col(f"`{x}`") for x in docs.columns])
