"""Columns with odd names pass through; benchmarks of many blocks and of shared windows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, jaccard, linededup, quality

from . import brute
from .conftest import same

ODD = ["a.b", "row.text", "tick`s", "white space", "select"]


@pytest.fixture(scope="module")
def odd(spark, rows):
    df = spark.createDataFrame(rows[:70], "doc_id long, text string").repartition(3)
    return df.select(F.lit("en").alias("lang"), *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in ODD), "doc_id", "text")


def whole(df, names):
    return {tuple(r) for r in df.select("doc_id", "text", *("`" + c.replace("`", "``") + "`" for c in names)).collect()}


@pytest.mark.parametrize("operator", ["lines", "decontaminate", "spans", "similar", "quality"])
def test_odd_column_names_pass_through(spark, rows, odd, operator):
    items = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    out = {"lines": lambda: linededup.dedup_lines(odd), "decontaminate": lambda: decontam.decontaminate(odd, items),
           "spans": lambda: decontam.decontaminate(odd, items, mode="spans"), "similar": lambda: jaccard.drop_similar(odd),
           "quality": lambda: quality.quality_filter(odd)}[operator]()
    assert out.columns == odd.columns
    got = whole(out, ODD)
    assert got and all(r[2:] == tuple(f"{c}{r[0]}" for c in ODD) for r in got)
    if operator in ("decontaminate", "similar"):
        assert {r[:2] for r in got} < set(rows[:70])


def test_windows_shared_by_many_items_over_blocks(spark):
    rnd = random.Random(5)
    prompt = " ".join(f"p{k}" for k in range(20))
    items = [(k, (prompt + " " if k % 3 == 0 else "") + " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 30)))) for k in range(300)]
    docs = [(d, " ".join(f"w{rnd.randrange(40)}" for _ in range(60)) + (" " + prompt if d % 4 == 0 else "")
             + (" " + items[d][1] if d % 5 == 0 else "")) for d in range(80)]
    table = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = brute.contamination(docs, items)
    assert max(r[3] for r in expected) >= 100
    for block_windows in (1_000_000, 700):
        found = decontam.contamination(frame, table, block_windows=block_windows)
        same(found, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], expected)
    windows, members = decontam.item_sets(decontam.benchmark_windows(table))
    assert windows.count() == windows.select("size", "gram").distinct().count()
    assert members.groupBy("set").count().agg(F.max("count")).first()[0] == 100       # the prompt's items are one set
    bad = {r[0] for r in expected if r[-1]}
    kept = decontam.decontaminate(frame, table, block_windows=700)
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in docs if r[0] not in bad)
