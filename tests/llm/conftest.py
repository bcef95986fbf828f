import random

import pytest
from pyspark.sql import functions as F

WORDS = ["alpha", "Beta", "gamma", "delta", "Éa", "naïve", "x1", "the", "of", "und", "la", "señor", "q", "日本", "rho", "tau"]


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".", "\n", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, repeated lines, odd and very long texts."""
    rnd = random.Random(7)
    base = [text(rnd, rnd.choice([3, 12, 40, 90, 200])) for _ in range(40)]
    passage, lines = text(rnd, 60), "\n".join(text(rnd, 6).replace("\n", " ") for _ in range(5))
    out = list(base) + base[3:9] + [" ".join(b.split(" ")[1:] + ["tau"]) for b in base[20:32]]
    out += [text(rnd, 20) + passage + text(rnd, 20) for _ in range(6)] + [text(rnd, 4) + "\n" + lines + "\n" + text(rnd, 4) for _ in range(5)]
    out += ["", " ", "\n\n\n\n", "one two", "One two", "a" * 120, "b" + "a" * 119, "a\x00b \x1c c\x85d　e", "  lead,, trail  \n",
            "<|endoftext|> text <|im_end|>", "It's I'll don't 'tis 3.14,15 (x)[y]", "é" * 60, "ﬁ İ K ß ÅΣ", text(rnd, 30_000)]
    return [(i, t) for i, t in enumerate(out)] + [(500, None), (501, None)]


@pytest.fixture(scope="session")
def frame(spark):
    """``frame(rows, **columns)``: a table with ``doc_id``, ``text`` and columns whose names operators use."""
    def make(rows, partitions=3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        clash = ["n_words", "hits", "items", "kept", "row", "doc", "key", "pos", "spans", "at", "own", "gone", "word", "part", "value",
                 "label", "class", "component", "node", "n"]
        return df.select(F.lit("en").alias("lang"), *[F.lit(7).alias(c) for c in clash], "doc_id", "text", F.lit(1.5).alias("score"))
    return make


def same(df, columns, expected):
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted(expected, key=str)
