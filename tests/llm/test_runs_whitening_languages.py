import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import catalog, centroids, periodic, whitening

SMALL = "/root/testdata/sf0.001"


# periodic runs


def all_runs(words):
    """Every maximal stretch with its smallest period, by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((b, e - b, q) for (b, e), q in found.items())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_row(doc_id, text):
    words = planted(doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    found = all_runs(words)
    gone = {k for a, length, q in found for k in range(a + q, a + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


UNITS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(UNITS, min_size=1, max_size=3))
def test_runs_of_words_made_of_powers(texts):
    words = [[b"%d" % x for unit, times in text for x in unit * times] for text in texts]
    found = periodic.text_runs([b" ".join(x) for x in words], 6, 4)
    assert [[(r["start"], r["length"], r["period"]) for r in x["runs"]] for x in found] == [all_runs(x) for x in words]


def test_fibonacci_and_thue_morse_words():
    a, b = b"0", b"01"
    while len(b) < 3000:
        a, b = b, b + a
    morse = [b"%d" % (bin(k).count("1") % 2) for k in range(2048)]
    fibonacci = [bytes([x]) for x in b[:800]]
    for words in (fibonacci, morse, fibonacci * 2, morse[:400] * 5):
        found = periodic.text_runs([b" ".join(words)], 6, 4)[0]["runs"]
        assert [(r["start"], r["length"], r["period"]) for r in found] == all_runs(words)


def test_long_periods_and_long_runs():
    rng = np.random.default_rng(3)
    unit = [b"%d" % x for x in rng.integers(0, 10**6, 5000)]
    words = unit[:77] + unit * 4 + unit[:9]
    found = periodic.text_runs([b" ".join(words), b"a " * 200_000], 6, 4)
    assert [(r["start"], r["length"], r["period"]) for r in found[0]["runs"]] == [(77, 20_009, 5000)]
    assert found[1]["runs"] == [{"start": 0, "length": 200_000, "period": 1}] and found[1]["collapsed"] == b"a"


def test_runs_query_agrees_with_trying_all_periods(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = catalog.QUERIES["op13_periodic_runs"](spark, SMALL)
    assert found.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert Counter(tuple(x) for x in found.collect()) == Counter(digest_row(*x) for x in docs)
    assert sum(x.n_runs > 0 for x in found.collect()) > 10


def test_runs_of_awkward_rows(spark):
    docs = rows.documents(spark, 20).withColumn("periods", F.lit("clash"))
    found, state = periodic.find_runs(docs)
    assert found.columns == [*docs.columns, "_periods"]
    for x in found.select("text", state.alias("s")).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (x.text or "").encode())
        assert x.s.n_words == len(words)
        if len(words) < 2000:
            assert [tuple(r) for r in x.s.runs] == all_runs(words)
    assert periodic.find_runs(rows.empty(spark))[0].count() == 0
    planted_rows = {x.doc_id: x.text for x in catalog.with_planted_runs(rows.documents(spark, 40)).where("doc_id is not null").collect()}
    for x in rows.documents(spark, 40).where("doc_id is not null").collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (x.text or "").encode())
        assert (planted_rows[x.doc_id] or "").encode().split() == planted(x.doc_id, words)


# whitening


def exact_covariance(vectors):
    n, size = len(vectors), len(vectors[0])
    sums = [sum(v[i] for v in vectors) for i in range(size)]
    cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in vectors), n**3) for j in range(size)] for i in range(size)]
    return sums, cov


def test_covariances_by_polarisation_are_exact():
    rng = np.random.default_rng(5)
    for top in (3, 10**4, 10**9, 2**62):
        x = rng.integers(-top, top, (40, 5))
        model = whitening.Whitener(5, 40, [int(sum(map(int, x[:, k]))) for k in range(5)], top)
        y = model.centred(x)
        pairs = [y[:, i] + y[:, j] for i in range(5) for j in range(i + 1, 5)]
        squares = [*whitening.square_sums(y, model.bits + 1), *whitening.square_sums(np.stack(pairs, 1), model.bits + 1)]
        _, cov = exact_covariance([[int(v) for v in row] for row in x])
        matrix, trace = whitening.covariances([int(s) for s in squares], 5, 40)
        assert matrix.tolist() == [[float(v) for v in row] for row in cov] and trace == float(sum(cov[k][k] for k in range(5)))


def test_whitening_query_agrees_with_exact_sums(spark):
    found = catalog.QUERIES["op12_whitening"](spark, SMALL)
    assert found.columns == "vec_id component n deviation whitened explained identity_error".split()
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    raw = {x.vec_id: [int(np.floor(256 * float(c))) for c in x.embedding] for x in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    fit = [list(v) for v in {tuple(v) for v in raw.values()}]
    n, x = len(fit), np.array(fit, float)
    mean = x.mean(axis=0)
    values, axes = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    sums = [sum(v[i] for v in fit) for i in range(len(mean))]
    whitened = {}
    for r in found.collect():
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(raw[r.vec_id], sums))
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
        want = (np.array(raw[r.vec_id]) - mean) @ axes[:, -r.component] / np.sqrt(values[-r.component])
        whitened.setdefault(r.component, []).append((r.whitened, want))
    assert sorted(whitened) == [1, 2, 3, 4] and {len(v) for v in whitened.values()} == {len(raw)}
    for pairs in whitened.values():
        got, want = np.array(pairs).T
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(k, [float(k % 5), float(k % 3), 0.5], "a") for k in range(30)] + [
        (100, None, None), (101, [1.0, None, 2.0], "b"), (102, [nan, 1.0, 1.0], "b"), (103, [1.0, -inf, 1.0], "b"), (104, [], "b"), (105, [1.0, 2.0], "b"),
        (None, [1.0, 1.0, 0.5], "c"), (3, [3.0, 0.0, 0.5], "again"),
    ]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, whitening string").repartition(5)
    model = whitening.fit_whitener(frame)
    assert (model.size, model.n, len(model.values)) == (3, 15, 3) and model.values[2] == 0 and model.identity_error < 1e-12
    out, state = whitening.whiten(frame, model)
    found = {(x.vec_id, x.whitening): x.s for x in out.select("vec_id", "whitening", state.alias("s")).collect()}
    assert out.count() == 34 and not {100, 101, 102, 103} & {k for k, _ in found}
    assert found[(104, "b")].whitened == found[(105, "b")].whitened == [] and found[(105, "b")].deviation is None
    assert found[(3, "a")] == found[(3, "again")] and found[(3, "a")].whitened[2] is None and None not in found[(3, "a")].whitened[:2]
    assert found[(None, "c")] == found[(1, "a")]
    for one in (frame.where("vec_id = 3"), frame.where("vec_id = 100"), frame.limit(0)):
        model = whitening.fit_whitener(one)
        assert model.identity_error is None
        assert all(set(x.s.whitened) <= {None} for x in whitening.whiten(one, model)[0].select(F.col("_whitening").alias("s")).collect())


def test_whitening_does_not_depend_on_partitions_and_holds_huge_entries(spark):
    frame = spark.createDataFrame([(k, [1e300 * (-1) ** k, 1e15 * k, float(k)]) for k in range(12)] * 3, "vec_id long, embedding array<double>")
    models = [whitening.fit_whitener(frame.repartition(k)) for k in (1, 7)]
    assert models[0].n == 12 and models[0].sums == models[1].sums and models[0].values.tolist() == models[1].values.tolist()
    deviations = [x[0] for x in whitening.whiten(frame, models[0])[0].select("whitening.deviation").collect()]
    assert deviations == [None] * 36


# languages


def test_held_out_texts_get_their_language(spark, data):
    found = catalog.QUERIES["op11_language_id"](spark, data)
    assert found.columns[:4] == "doc_id held_out lang_pred score".split() and [t for _, t in found.dtypes][:4] == ["bigint", "boolean", "string", "double"]
    truth = {x.doc_id: (x.lang, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    tested = right = 0
    for x in found.collect():
        lang, text = truth[x.doc_id]
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert x.lang_pred == "und"
        elif x.held_out and lang:
            tested, right = tested + 1, right + (x.lang_pred == lang)
    assert tested > 150 and right >= 0.98 * tested


def test_gram_counts_and_vectors_by_hand():
    import pyarrow as pa

    texts = [" ab ab ", None, " ü ", ""]
    counts = centroids.gram_counts(*centroids.byte_column(pa.array(texts)))
    sizes = [len((t or "").encode()) for t in texts]
    assert counts.sum(axis=1).tolist() == [sum(max(0, n - k) for k in range(centroids.LONGEST)) for n in sizes]
    # a text has the same grams wherever it stands in a slice
    alone = centroids.gram_counts(*centroids.byte_column(pa.array([texts[2]])))
    assert (alone[0] == counts[2]).all()
    units = centroids.vectors(pa.array(texts), np.ones(centroids.SLOTS))
    assert np.allclose((units * units).sum(axis=1), [1, 0, 1, 0])


def test_nearest_centroid_agrees_with_plain_cosines(spark):
    import pyarrow as pa

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    models = [centroids.learn(docs.repartition(k), seeds=20) for k in (1, 6)]
    assert (models[0].centres == models[1].centres).all() and (models[0].least == models[1].least).all() and models[0].langs == ["de", "en", "es", "fr"]
    found, state = centroids.identify(docs, models[0])
    for x in found.select(centroids.letters(F.col("text")).alias("plain"), state.alias("s")).collect():
        cosine = models[0].centres @ centroids.vectors(pa.array([x.plain]), models[0].idf)[0]
        assert x.s.score == pytest.approx(cosine.max(), abs=1e-8) and x.s.lang == models[0].langs[models[0].owner[cosine.argmax()]]
        assert x.s.rejected == (x.s.score < models[0].least[cosine.argmax()]) and x.s.distance == pytest.approx(1 - x.s.score)


def test_strange_texts_are_rejected_and_awkward_rows_have_results(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = centroids.learn(docs)
    odd = spark.createDataFrame(
        [(1, "Съешь же ещё этих мягких французских булок"), (2, None), (3, ""), (4, " 12 ½ !? "), (5, "ß"), (6, "x" * 2_000_000), (6, "́")],
        "doc_id long, text string",
    ).withColumns({"letters": F.lit("clash"), "language": F.lit("clash")})
    out, state = centroids.identify(odd, model)
    assert out.columns == [*odd.columns, "_language"]
    found = [(x.doc_id, x.s) for x in out.select("doc_id", state.alias("s")).collect()]
    assert [k for k, _ in sorted(found, key=lambda x: x[0])] == [1, 2, 3, 4, 5, 6, 6]
    assert {k for k, s in found if s.lang == "und"} == {2, 3, 4, 6} and all(s.rejected and s.score == 0 for _, s in found if s.lang == "und")
    assert all(s.rejected for k, s in found if k in (1, 6))
    empty = centroids.learn(rows.empty(spark))
    assert empty.langs == [] and {x.s.lang for x in centroids.identify(odd, empty)[0].select(F.col("_language").alias("s")).collect()} == {"und"}
    assert centroids.identify(rows.empty(spark), model)[0].count() == 0
    awkward = rows.documents(spark, 20)
    model = centroids.learn(awkward)
    assert model.langs == ["en"] and len(model.owner) <= centroids.CLUSTERS
    assert centroids.identify(awkward, model)[0].count() == awkward.count()
