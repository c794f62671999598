"""N-gram Jaccard join that skips by relations between sets.

Texts with the same shingle set become one class. A class's shingles are ordered by
how often they are likely to occur in the corpus, seldom ones first, which their hash
bucket and the words in them tell; two sets with enough in common share a shingle among
their first ones. Of these index lists only those with two classes or more matter: the
pairs of a short one have to pass the parities of both sets, a long one is read in blocks
by position, and a block is skipped where its position leaves too few shingles to come.
What long lists tie together is compared by parities before it counts. The rest forms
families, and each family is joined in tasks of bounded size: the overlaps of one set with
all others are computed from its index lists, those of a highly similar set by adding and
subtracting the lists of the shingles in which the two differ. Every pair that may reach
the threshold is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import SPACED, byte_column, lowered, mix, prefix_hashes, range_hashes, settle, signed, slabs, vector_sum, window_hashes, word_spans

SHINGLE = 3
THRESHOLD = (90, 100)
ORDER_BITS = 20
#: classes of an index list that meet pair by pair; longer ones go by blocks, and beyond the second number in parts
LIST_PAIRS, LIST_CLASSES = 32, 1024
#: marks of the ids whose sets are compared: 32 and more for an id, a table of a fixed size at most, more ids only let more rows through
MARK_BITS, MARK_BLOCK = (20, 26), 16
#: power of two by which two words of one language or topic may come together more often than by chance
TOGETHER = 3
#: least and most bits of a set's parities
PARITY_BITS = (1 << 6, 1 << 18)
#: sets and bytes of a block whose parities are compared
TIE_SETS, TIE_BYTES = 4096, 1 << 25
#: what index lists give: pairs of ids; ids that a long list ties; an id and the long list it is in
PAIR, TIE, MEMBER = range(3)
BLOCK = 64
#: shingles and sets of a family block
BLOCK_SHINGLES = 1 << 20
BLOCK_SETS = 2048


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending text by text, and each text's first one.

    A text of fewer words than ``size``, but not none, has the whole sequence as its
    only shingle.
    """
    hashes, first, _ = weighed_sets(data, offsets, size)
    return hashes, first


def weighed_sets(data: np.ndarray, offsets: np.ndarray, size: int, weigh: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The sets of ``shingle_sets``, and ``weigh(shingles, words)`` of each shingle, where ``words`` are the word hashes from its place on."""
    words, word_first = text_words(data, offsets)
    hashes, first, at = shingle_runs(words, word_first, size)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(offsets))), weigh and weigh(hashes, words, at[order][fresh])


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's first one."""
    starts, ends, first = word_spans(data, offsets, SPACED)
    return range_hashes(prefix_hashes(lowered(data, SPACED)), starts, ends), first


def shingle_runs(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in their order, repeats included, each text's first one, and the place of each shingle's first word."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(max(0, len(words) - size + 1))
    full = at[at + size <= first[owner[at] + 1]] if len(at) else at
    out, of, at = [window_hashes(words, size)[full]], [owner[full]], [full]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        total = np.full(len(short), n, np.uint64)
        for k in range(n):
            total = mix(total * np.uint64(31) + words[first[short] + k])
        out.append(total)
        of.append(short)
        at.append(first[short])
    hashes, owner, places = np.concatenate(out), np.concatenate(of), np.concatenate(at)
    order = np.argsort(owner, kind="stable")
    return hashes[order], np.searchsorted(owner[order], np.arange(len(counts) + 1)), places[order]


def least_overlap(a, b, threshold: tuple[int, int]):
    """Shingles that sets of these sizes must share: intersection * t >= union * s for a threshold s / t."""
    s, t = threshold
    return -(-s * (a + b) // (s + t))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def bucket_counts(docs: DataFrame, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles and how many words of the corpus fall into each of 2**bits hash buckets."""
    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in slabs(batches, "text"):
            words, first = text_words(*byte_column(batch.column("text")))
            for k, hashes in enumerate((shingle_runs(words, first, size)[0], words)):
                total[k] += np.bincount(_bucket(hashes, bits), minlength=1 << bits)
        return total.ravel()

    shingles, words = vector_sum(docs.select("text"), fold, 2 << bits, "<i8", 8192).reshape(2, -1)
    return shingles, words


def likely_counts(shingles: np.ndarray, words: np.ndarray, size: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function of shingle hashes, word hashes and places: numbers in the order of how often a shingle is likely to occur.

    In a large corpus all buckets are full of seldom shingles. So the power of two comes
    first of what a bucket holds beyond the usual, or of what the words would make by
    chance if that is more, but no more than the seldomest word has; then the bucket's
    count. What chance makes so seldom that words of one topic may outdo it is not told apart.
    """
    bits = (len(shingles) - 1).bit_length()
    usual = shingles.sum() / len(shingles)
    beyond = np.log2(np.maximum(shingles - usual - 2 * np.sqrt(usual), 2.0 ** -(TOGETHER * (size - 1)))).astype(np.float32)
    share = np.log2(np.maximum(words, 1)).astype(np.float32)
    total = np.float32(np.log2(max(1, int(words.sum()))))

    def weigh(hashes: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = share[_bucket(of, bits)]
        chance, most = own[at], own[at]
        for k in range(1, size):
            # a text of fewer words has one shingle only, whose place in the order does not matter
            more = own[np.minimum(at + k, max(0, len(own) - 1))]
            chance, most = chance + more - total, np.minimum(most, more)
        bucket = _bucket(hashes, bits)
        power = np.floor(np.minimum(most, np.maximum(chance, beyond[bucket]))).astype(np.int64)
        return (power << 32) + shingles[bucket]

    return weigh


def _digest_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums whose differences are the two numbers of a set's digest."""
    sums = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(mix(hashes), out=sums[0, 1:])
    np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
    return sums


def _mark_of(ids: np.ndarray, bits: int) -> np.ndarray:
    return _bucket(mix(ids.astype(np.int64).view(np.uint64)), bits)


def id_marks(ids: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed, in which those of the ids (doc_id) are set; 2**bits / 8 bytes come to the driver at most."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_mark_of(batch.column("doc_id").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> MARK_BLOCK).astype(np.int32)), pa.array((at & (1 << MARK_BLOCK) - 1).astype(np.int32))], names=["block", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, at = batch.column("block").to_numpy(), batch.column("place").to_numpy()
            for k in np.unique(blocks).tolist():
                marks.setdefault(k, np.zeros(1 << MARK_BLOCK, bool))[at[blocks == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(marks), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in marks.values()], pa.binary())], names=["block", "marks"])

    total = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << MARK_BLOCK - 3
    for row in ids.select("doc_id").mapInArrow(places, "block int, place int").repartition("block").mapInArrow(pack, "block int, marks binary").collect():
        total[row.block * size: (row.block + 1) * size] = np.frombuffer(row.marks, np.uint8)
    return total


def _documents(docs: DataFrame, size: int, threshold: tuple[int, int], bits: int) -> DataFrame:
    """(doc_id, n, high, low, parity, first): size, digest and parities of each set, and its first shingles in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast([np.minimum(x, 2**31 - 1).astype(np.int32) for x in bucket_counts(docs, size, bits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = likely_counts(*shared.value, size)
        for batch in slabs(batches, "text"):
            hashes, first, likely = weighed_sets(*byte_column(batch.column("text")), size, weigh)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((hashes, likely, owner))
            keep = n - least_overlap(n, -(-n * threshold[0] // threshold[1]), threshold) + 1
            rank = np.arange(len(hashes)) - first[owner]
            prefix = signed(hashes[order][rank < keep[owner]])
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, np.minimum(keep, n), 0))])
            digest = [signed(x[first[1:]] - x[first[:-1]]) for x in _digest_sums(hashes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(x) for x in digest), pa.array(parities(hashes, first), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix))],
                names=["doc_id", "n", "high", "low", "parity", "first"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, high long, low long, parity binary, first array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, bool]]:
    """Rows in whole groups of neighbours with the same keys: columns, the groups' first rows and one past the last, False.

    A group longer than ``most`` comes alone in parts, marked True, each starting with
    the last row of the part before.
    """
    held: pa.Table | None = None
    part = False
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        columns = {x: held.column(x).to_numpy() for x in held.column_names}
        change = np.zeros(held.num_rows - 1, bool)
        for x in keys:
            change |= columns[x][1:] != columns[x][:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        if part and len(cuts) > 1:
            yield {k: v[: cuts[1]] for k, v in columns.items()}, cuts[:2], True
            cuts, part = cuts[1:], False
        if len(cuts) > 1:
            yield {k: v[cuts[0]: cuts[-1]] for k, v in columns.items()}, cuts - cuts[0], False
        begin = cuts[-1]
        if most and held.num_rows - begin > most:
            columns = {k: v[begin:] for k, v in columns.items()}
            yield columns, np.array([0, held.num_rows - begin]), True
            begin, part = held.num_rows - 1, True
        held = held.slice(begin)
    if held is not None and held.num_rows:
        yield {x: held.column(x).to_numpy() for x in held.column_names}, np.array([0, held.num_rows]), part


def short_pairs(rows: dict[str, np.ndarray], cuts: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of classes within short lists that their positions and sizes allow."""
    size = np.diff(cuts)
    group = np.repeat(np.where(size <= LIST_PAIRS, np.arange(len(size)), -1 - np.arange(len(size))), size)
    ids, n, place = rows["id"], rows["n"], rows["place"]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, LIST_PAIRS):
        x = np.flatnonzero((group[step:] == group[:-step]) & (group[step:] >= 0))
        if not len(x):
            break
        y = x + step
        most = np.minimum(place[x], place[y]) + 1 + np.minimum(n[x] - place[x], n[y] - place[y]) - 1
        fits = (most >= least_overlap(n[x], n[y], threshold)) & (ids[x] != ids[y])
        a.append(ids[x[fits]])
        b.append(ids[y[fits]])
    return np.concatenate(a), np.concatenate(b)


def parities(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set, the parities of how many shingles fall into each of a power of two of buckets, about its size."""
    n = np.diff(first)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), *PARITY_BITS)
    begin = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    bucket = begin[owner] + (mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(bucket, minlength=begin[-1]) & 1 > 0, bitorder="little").tobytes()
    return [packed[a // 8: b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def fewest_differences(a: bytes, b: bytes) -> int:
    """A bound from below on the shingles that only one of two sets has, from their parities."""
    if len(a) > len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 4 * len(b)
    while size >= 8 * len(a):
        y = (y >> size) ^ (y & (1 << size) - 1)
        size //= 2
    return (x ^ y).bit_count()


def folded(sets: list[bytes]) -> np.ndarray:
    """Parities of sets as rows of 64-bit numbers, all as short as the shortest."""
    width = min(len(x) for x in sets)
    out = np.zeros((len(sets), width // 8), np.uint64)
    for k, x in enumerate(sets):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, width // 8))
    return out


def possible_ties(rows: dict[str, np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the sets of two blocks, or of one (side 0 only), that connects all pairs whose sizes and parities let them link.

    Two sets of role 1 are not compared.
    """
    ids, n, role, side = rows["id"], rows["n"], rows["role"], rows["side"]
    bits = folded(list(rows["parity"]))
    alone = not side.any()
    root = np.arange(len(ids))
    for k in np.flatnonzero(side == 0):
        # sets that are tied already need no look
        other = np.flatnonzero((root != root[k]) & (role + role[k] < 2) & (alone | (side == 1)))
        other = other[np.minimum(n[other], n[k]) >= least_overlap(n[other], n[k], threshold)]
        differ = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
        hit = other[differ <= n[other] + n[k] - 2 * least_overlap(n[other], n[k], threshold)]
        if len(hit):
            trees = np.unique(root[np.append(hit, k)])
            root[np.isin(root, trees)] = trees[0]
    joined = root != np.arange(len(ids))
    return ids[joined], ids[root[joined]]


def long_list(rows: dict[str, np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the classes of a long index list that holds all pairs that may reach the threshold.

    The list stands in blocks by position. What two sets can share is bounded by the
    smaller position, the shingle itself and what comes behind it; a block whose bound
    is too low is skipped whole.
    """
    order = np.lexsort((rows["id"], rows["place"]))
    ids, n, place = rows["id"][order], rows["n"][order], rows["place"][order]
    a, b = [], []
    rest = n - place - 1
    for low in range(0, len(ids), BLOCK):
        block = slice(low, low + BLOCK)
        for other in range(low, len(ids), BLOCK):
            against = slice(other, other + BLOCK)
            most = place[block].max() + 1 + min(rest[block].max(), rest[against].max())
            if most < least_overlap(n[block].min(), n[against].min(), threshold):
                continue
            x, y = np.meshgrid(np.arange(*block.indices(len(ids))), np.arange(*against.indices(len(ids))), indexing="ij")
            fits = (x < y) & (np.minimum(place[x], place[y]) + 1 + np.minimum(rest[x], rest[y]) >= least_overlap(n[x], n[y], threshold))
            a.append(x[fits])
            b.append(y[fits])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(ids))
    for _ in range(len(ids)):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    joined = root != np.arange(len(ids))
    return ids[joined], ids[root[joined]]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) of every id in the edges (a, b): the smallest id reachable.

    Each round every id takes the smallest label among its neighbours' and then the
    label of that label; rounds are written to the shared folder, their number grows
    with the logarithm of a component's width. No set of ids comes to the driver.
    """
    edges = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), f"{name}-edges")
    labels = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root"))
    labels = settle(labels, f"{name}-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("root").alias("next"))
        new = new.join(jump, "new", "left").select("id", F.least("new", "next").alias("root"), "old")
        new = settle(new, f"{name}-labels")
        done = new.where("root != old").isEmpty()
        labels = new.select("id", "root")
        if done:
            return labels


class Overlaps:
    """Exact overlaps of sets with all sets of a block, from its index lists."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owner[order]
        self.last: np.ndarray | None = None
        self.counts = np.zeros(self.count, np.int64)

    def _lists(self, tokens: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        size = high - low
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        return np.bincount(self.owners[rows], minlength=self.count)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Overlaps of a sorted set; from the set before it where the two differ in fewer shingles than it has."""
        if self.last is not None:
            gone = np.setdiff1d(self.last, tokens, assume_unique=True)
            come = np.setdiff1d(tokens, self.last, assume_unique=True)
        if self.last is not None and len(gone) + len(come) < len(tokens):
            self.counts = self.counts + self._lists(come) - self._lists(gone)
        else:
            self.counts = self._lists(tokens)
        self.last = tokens
        return self.counts


def family_links(rows: dict[str, np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, root, links) of two blocks of a family, or of one block with itself (side 0 only).

    ``root`` ties the ids that links between these blocks connect, ``links`` is the
    number of documents that an id's links here lead to. Sets come in an order in
    which neighbours differ little.
    """
    s, t = threshold
    side, ids, weights = rows["side"], rows["id"], rows["weight"]
    sets = [np.frombuffer(x, "<i8") for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets])
    alone = not side.any()
    probes = np.flatnonzero(side == 0)
    targets = probes if alone else np.flatnonzero(side == 1)
    probes = probes[np.lexsort((sizes[probes], [int(sets[k][0]) for k in probes]))]
    overlaps = Overlaps([sets[k] for k in targets])
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for k in probes if len(targets) else ():
        shared = overlaps.of(sets[k])
        hit = targets[t * shared >= s * (sizes[k] + sizes[targets] - shared)]
        hit = hit[hit != k]
        if not len(hit):
            continue
        links[k] += weights[hit].sum()
        if not alone:
            links[hit] += weights[k]
        trees = np.unique(root[np.append(hit, k)])
        if len(trees) > 1:
            root[np.isin(root, trees)] = trees[0]
    return ids, ids[root], links


def _checked_ties(edges: DataFrame, signs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between the ids that long lists tie, where sizes and parities (id, n, parity) let pairs link.

    What ties connect is compared as a whole, or list by list where that sends fewer
    rows. Sets meet those of their own cell and of the next, since sets that link are of
    about one size; a cell of many sets is compared by pairs of blocks.
    """
    ties = edges.where(f"kind = {TIE}").select("a", "b")
    if ties.isEmpty():
        return ties
    tied = components(ties, "ties").withColumnRenamed("root", "family")
    lists = edges.where(f"kind = {MEMBER}").select(F.col("a").alias("id"), F.col("b").alias("list"))
    rows = tied.groupBy("family").agg(F.count("*").alias("ids")).join(tied.join(lists, "id").groupBy("family").agg(F.count("*").alias("rows")), "family")
    rows = rows.select("family", (F.col("rows") < F.col("ids") * F.ceil(F.col("ids") / TIE_SETS)).alias("apart"))
    tied = tied.join(rows, "family")
    whole = tied.where("not apart").select("id", "family", F.lit(False).alias("apart"))
    apart = tied.where("apart").join(lists, "id").select("id", F.col("list").alias("family"), "apart")
    tied = whole.union(apart).join(signs, "id").dropDuplicates(["id", "n", "family", "apart", "parity"])
    # a little wider than the ratio of sizes, so that no rounding puts two cells between sets that link
    cell = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(1e-6, 1.0001 * math.log(threshold[1] / threshold[0])))).cast("int")
    tied = settle(tied.withColumn("cell", cell), "jaccard-tied")
    roles = tied.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("cell", F.col("cell") - F.col("role"))
    blocks = roles.groupBy("apart", "family", "cell").agg(
        F.greatest(F.ceil(F.count("*") / TIE_SETS), F.ceil(F.sum(F.octet_length("parity")) / TIE_BYTES)).cast("int").alias("blocks"),
        F.count("*").alias("rows"), F.min("role").alias("least"),
    ).where("rows > 1 and least = 0").select("apart", "family", "cell", "blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = roles.join(blocks, ["apart", "family", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(
        "apart", "family", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "role", (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "parity",
    )
    keys = ["apart", "family", "cell", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts, _ in _groups(batches, keys):
            for begin, end in zip(cuts[:-1], cuts[1:]):
                a, b = possible_ties({k: v[begin:end] for k, v in rows.items()}, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.repartition(*keys).sortWithinPartitions(*keys, "n", "id").mapInArrow(compare, "a long, b long")


def link_documents(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, bits: int = ORDER_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of every row of (doc_id, text).

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a set holds the distinct
    shingles of ``size`` words; two documents link when threshold[1] * intersection >=
    threshold[0] * union. ``class_id`` is the smallest doc_id with the same set,
    ``component_id`` the smallest one that links reach, ``n_links`` the number of other
    rows that the row links with. Null and word-less texts have the empty set, link with
    nothing and are their own component. A row with a null doc_id links with nothing and
    has a null component. Repeated rows stay; rows of one doc_id are expected to have one
    text. Other columns are ignored, an empty table gives no rows.
    """
    documents = settle(_documents(docs, size, threshold, bits), "jaccard-documents")
    classes = documents.where("n > 0 and doc_id is not null").groupBy("n", "high", "low").agg(F.min("doc_id").alias("id"), F.count("*").alias("weight"))
    named = classes = settle(classes, "jaccard-classes")

    def join_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts, part in _groups(batches, ["shingle"], LIST_CLASSES):
            if part:
                # a part's classes meet at its smallest id, and the next part at its last row
                yield edges_of(rows["id"], np.full(len(rows["id"]), rows["id"].min()), TIE)
                yield edges_of(rows["id"], rows["shingle"], MEMBER)
                continue
            yield edges_of(*short_pairs(rows, cuts, threshold), PAIR)
            for k in np.flatnonzero(np.diff(cuts) > LIST_PAIRS):
                yield edges_of(*(tie := long_list({x: v[cuts[k]: cuts[k + 1]] for x, v in rows.items()}, threshold)), TIE)
                ids = np.unique(np.concatenate(tie))
                yield edges_of(ids, np.full(len(ids), rows["shingle"][cuts[k]]), MEMBER)

    def edges_of(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        if kind != MEMBER:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in ("n", "m", "x", "y"))
            fits = [fewest_differences(p, q) <= i + j - 2 * least_overlap(i, j, threshold) for i, j, p, q in zip(n, m, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    first = documents.select("doc_id", "n", "high", "low", "first").join(
        named.select(F.col("id").alias("doc_id"), "n", "high", "low"), ["doc_id", "n", "high", "low"], "left_semi"
    ).select(F.col("doc_id").alias("id"), "n", F.posexplode("first").alias("place", "shingle"))
    lists = first.select("shingle", "id", F.col("n"), F.col("place").cast("long").alias("place"))
    lists = lists.repartition("shingle").sortWithinPartitions("shingle", "n", "id")
    edges = settle(lists.mapInArrow(join_lists, "a long, b long, kind int").where(f"a != b or kind = {MEMBER}").distinct(), "jaccard-pairs")
    # pairs of short lists have to pass the parities of both sets
    parity = documents.select("doc_id", "n", "high", "low", "parity").join(named.select(F.col("id").alias("doc_id"), "n", "high", "low"), ["doc_id", "n", "high", "low"], "left_semi")
    pairs = edges.where(f"kind = {PAIR}").join(parity.select(F.col("doc_id").alias("a"), "n", F.col("parity").alias("x")), "a")
    pairs = pairs.join(parity.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y")), "b")
    pairs = pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(may_link, "a long, b long")
    signs = parity.select(F.col("doc_id").alias("id"), "n", "parity")
    families = components(pairs.union(_checked_ties(edges, signs, threshold)), "families")
    members = families.join(named, "id").select("id", F.col("root").alias("family"), "n", "high", "low", "weight")
    members = settle(members, "jaccard-members")
    blocks = members.groupBy("family").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks")
    )
    wanted = members.join(blocks, "family").select(F.col("id").alias("doc_id"), "family", "high", "low", "weight", "blocks")

    bits = min(MARK_BITS[1], max(MARK_BITS[0], (32 * members.count()).bit_length()))
    marks = docs.sparkSession.sparkContext.broadcast(id_marks(wanted, bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows whose id is not marked go before anything is shuffled
        for batch in batches:
            at = _mark_of(batch.column("doc_id").to_numpy(), bits)
            batch = batch.filter(pa.array(marks.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            for part in slabs(iter([batch]), "text"):
                hashes, at = shingle_sets(*byte_column(part.column("text")), size)
                digests = [signed(x[at[1:]] - x[at[:-1]]) for x in _digest_sums(hashes)]
                packed = signed(hashes).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x) for x in digests), pa.array([packed[8 * a: 8 * b] for a, b in zip(at[:-1], at[1:])], pa.binary())],
                    names=["doc_id", "high", "low", "shingles"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    texts = texts.mapInArrow(sets, "doc_id long, high long, low long, shingles binary").join(wanted, ["doc_id", "high", "low"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = texts.withColumnRenamed("doc_id", "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(
        "family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "weight", "shingles",
    )

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts, _ in _groups(batches, ["family", "low", "high"]):
            for begin, end in zip(cuts[:-1], cuts[1:]):
                _, once = np.unique(rows["id"][begin:end], return_index=True)
                columns = family_links({k: v[begin:end][once] for k, v in rows.items()}, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "links"])

    pairs = pairs.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    links = settle(pairs.mapInArrow(join_blocks, "a long, b long, links long"), "jaccard-links")
    roots = components(links, "components").withColumnRenamed("id", "class_id")
    degrees = links.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    classes = classes.withColumnRenamed("id", "class_id").join(roots, "class_id", "left").join(degrees, "class_id", "left")
    joined = documents.drop("first", "parity").withColumn("known", F.col("doc_id").isNotNull())
    joined = joined.join(classes.withColumn("known", F.lit(True)), ["n", "high", "low", "known"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "class_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each component of ``docs``, with its columns: the one with the smallest doc_id, once.

    ``size`` and ``threshold`` are those of ``link_documents``.
    """
    linked = link_documents(docs, size, threshold)
    stays = linked.where("doc_id = component_id or component_id is null").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null")).select(*[F.col(f"`{x}`") for x in docs.columns])
