"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, hits long, lines string, quality int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    pool = [f"{a}{b}{c}" for a in ("th", "re", "on", "ciónñ", "Ü") for b in ("an", "er", "st", "ou") for c in ("", "ing", "ed.", "ly,")]
    pool += [f"w{k}" for k in range(vocabulary)]
    return "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(words))


def documents(spark, n: int = 60):
    texts = [(k, prose(k, 20 + 7 * k)) for k in range(n)]
    base = prose(1000, 300)
    texts += [(n + k, base) for k in range(4)]
    edited = base.split(" ")
    for k in range(6):
        copy = list(edited)
        copy[5 * k] = f"new{k}"
        texts.append((n + 10 + k, " ".join(copy)))
    texts += [
        (n + 30, None), (n + 31, ""), (n + 32, " \n\t "), (n + 33, "one"), (n + 34, "one two"), (n + 35, "ONE Two"), (n + 36, prose(7, 30_000)), (n + 37, "x" * 200_000),
        (n + 38, "<|endoftext|> a<|startoftext|>b it's don't  12 ÀÉ e\u0301 ½ .. !! word.. ß"), (None, prose(3, 40)), (None, None), (5, texts[5][1]),
        (n + 39, "the same line here\n" * 30), (n + 40, " | ".join(prose(9, 60).split())),
    ]
    rows = [(k, t, None if k is None or k % 5 == 0 else "en", f"src{(k or 0) % 3}", len(t) if t is not None else None, "clash", 1, "clash", 0) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, n: int = 60):
    rows = [(k, int(k % 4 != 0), 0) for k in range(n)] + [(None, 1, 0), (3, None, 0), (999_999, 1, 0), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
