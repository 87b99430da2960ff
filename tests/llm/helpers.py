"""Small documents with all that operators must stand: nulls, empties, ties, copies, long texts, odd columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it was on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people".split()


def rows(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts, ids=None):
    data = rows(texts)
    if ids is not None:
        data = [(i, *r[1:]) for i, r in zip(ids, data, strict=True)]
    return spark.createDataFrame(data, SCHEMA)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 0, n: int = 40) -> list:
    """Texts with shared passages, copies, near copies, repeats, other scripts and empties."""
    rng = random.Random(seed)
    shared = [prose(rng, 60) for _ in range(3)]
    out: list = [None, "", "   \n\t ", "one", "two words", "漢字 ÄÖÜ é́ \U0001f600 end"]
    for i in range(n):
        parts = [prose(rng, rng.randint(5, 120))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        out.append("\n".join(parts) if i % 2 else " ".join(parts))
    out += [out[8], out[8], out[9] + " tail", out[10][5:], "same " * 300, "x" * 3000, shared[0] + shared[0]]
    return out


def odd_frames(spark):
    """(name, DataFrame): tables that must not crash an operator."""
    empty = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, "some words here", None, "s", 3), (2, "", "en", None, 0)], SCHEMA)
    twice = spark.createDataFrame([(7, "a b c " * 30, "en", "s", 1), (7, "a b c " * 30, "en", "s", 1), (7, "other text " * 30, "en", "s", 1)], SCHEMA)
    clash = spark.createDataFrame([(1, "a few words " * 9, "en", "s", 1, 1.0, "z", 5, "y", 3)], SCHEMA + ", score double, text_2 string, fp long, hash string, batch int")
    return [("empty", empty), ("nulls", nulls), ("twice", twice), ("clash", clash)]


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))
