"""Benchmark decontamination: hash set of normalised test n-grams against training windows.

The benchmark's windows are a table, written once; the distinct ones are broken by their hash
into blocks of at most about ``block_windows``.  Each block is a broadcast of proven size: a
task slides the same windows over each document's words, looks their hashes up, compares the
words of every hit exactly, and adds the covered words to what earlier blocks found.  A
benchmark of one block takes one map step with no shuffle of documents; a larger one takes a
pass for each block, the marked documents written in between, so a task never holds more than
one block.  Which items a window has stays in a table: windows of the same items share one set,
and the sets that a document hits are joined with their items afterwards.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ``width``
consecutive words of an item; an item with fewer words, but not none, is one window.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item has
no window; items that share an ``item_id`` are one item, a null ``item_id`` reads
``null``; repeated documents are judged row by row; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import kept_table, map_arrow, quoted, remove, written

WIDTH = 13
BLOCK_WINDOWS = 1_000_000
CONTAMINATED_SHARE = 20          # a document is contaminated when 1/20 of its words are hit

HITS = "array<struct<start:int,end:int>>"
_HITS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Rows ``(size, hash, gram, item)``: the distinct windows of each item, their words
    joined by one space."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in X.blocks(batches, 1):
            block = X.Texts(texts)
            s, e = block.words(X.ALNUM_WORD)
            h = X.hash_words(block.buf, s, e)
            first, last = block.owner(s)
            rows = []
            for item, a, b in zip(batch.column(0).to_pylist(), first, last):
                size = min(width, b - a)
                if size:
                    words = [X.FOLD[block.buf[s[i]:e[i]]].tobytes() for i in range(a, b)]
                    rows += [(size, int(x), b" ".join(words[k:k + size]), item)
                             for k, x in enumerate(X.hash_windows(h[a:b], size).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.string()))],
                names=["size", "hash", "gram", "item"])

    plain = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(text_col).cast("string").alias("text"))
    return map_arrow(plain, windows, "size int, hash long, gram binary, item string").distinct()


class _Grams:
    """One block of benchmark windows as hash arrays in sorted order, with a bit filter before them."""

    def __init__(self, table: pa.Table):
        size_of = table["size"].to_numpy()
        key_of = table["hash"].to_numpy().astype(np.int64).view(np.uint64)
        set_of = table["set"].to_numpy()
        self.sizes = {}
        for size in np.unique(size_of).tolist():
            at = np.flatnonzero(size_of == size)
            at = at[np.argsort(key_of[at], kind="stable")]
            keys = key_of[at]
            shift = np.uint64(64 - min(24, max(16, (64 * len(keys)).bit_length())))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[keys >> shift] = True
            self.sizes[size] = (keys, shift, seen, table["gram"].combine_chunks().take(pa.array(at)), set_of[at])

    def find(self, block: X.Texts, s, e, h, text_of) -> Iterator[tuple[int, int, int]]:
        """Verified hits ``(first word, words, item set)``."""
        for size, (keys, shift, seen, grams, sets) in self.sizes.items():
            w = X.hash_windows(h, size)
            at = np.flatnonzero(seen[w >> shift])
            at = at[text_of[at] == text_of[at + size - 1]]
            low, high = np.searchsorted(keys, w[at]), np.searchsorted(keys, w[at], "right")
            found = high > low
            for i, a, b in zip(at[found], low[found], high[found]):
                words = b" ".join(X.FOLD[block.buf[s[j]:e[j]]].tobytes() for j in range(i, i + size))
                for k in range(a, b):
                    if grams[k].as_py() == words:
                        yield i, size, int(sets[k])


def item_sets(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(size, hash, gram, set)`` and the members ``(set, item)`` of each set of
    items that share windows: windows of the same items have one set.  Sets are told apart by
    their number of items and two hashes of them, which add up before a shuffle; none is
    gathered, so a window of very many items is one row here and its items are rows there."""
    key = ["size", "hash", "gram"]
    windows = grams.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("x1"),
                                      F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("x2"))
    sets = written(windows.groupBy("n", "x1", "x2").agg(F.min(F.struct(*key)).alias("one"))
                   .select("*", F.monotonically_increasing_id().alias("set")), "item-sets")
    own = sets.select("set", *(F.col(f"one.{c}").alias(c) for c in key))
    return (written(windows.join(sets, ["n", "x1", "x2"]).select(*key, "set"), "item-windows"),
            written(grams.join(own, key).select("set", "item"), "item-members"))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint sorted word spans that cover what ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n, *(f"{n}__{k}" for k in range(len(taken) + 1))) if x.lower() not in taken) for n in names]


def mark(docs: DataFrame, windows: DataFrame, text_col: str = "text",
         block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, whose names come back too: the number of words, the
    disjoint word spans hit by ``windows`` (size, hash, gram, set), and the sets of items whose
    windows occur (distinct, sorted)."""
    spark: SparkSession = docs.sparkSession
    n_blocks = max(1, -(-windows.count() // block_windows))
    n_words, hits, sets = _free(docs, "n_words", "hits", "sets")
    out = docs.select("*", F.lit(0).cast("long").alias(n_words), F.lit(None).cast(HITS).alias(hits),
                      F.lit(None).cast("array<long>").alias(sets))
    at, before = docs.columns.index(text_col), None
    for k in range(n_blocks):
        block = windows.where(F.pmod(F.col("hash"), F.lit(n_blocks)) == k).select("size", "hash", "gram", "set").toArrow()
        shared = spark.sparkContext.broadcast(block)
        out = map_arrow(out, _marker(shared, at, len(out.columns)), out.schema)
        if k < n_blocks - 1:                    # the next block is a pass of its own, this one's broadcast goes
            out, path = kept_table(out, "marked")
            shared.destroy()
            if before:
                remove(spark, before)
            before = path
    return out, n_words, hits, sets


def _marker(shared, at: int, n_cols: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(shared.value)
        for batch, texts in X.blocks(batches, at):
            block = X.Texts(texts)
            s, e = block.words(X.ALNUM_WORD)
            h = X.hash_words(block.buf, s, e)
            first, last = block.owner(s)
            text_of = np.repeat(np.arange(len(texts)), last - first)
            found: dict[int, tuple[list, set]] = {}
            for i, size, own_set in grams.find(block, s, e, h, text_of):
                spans, own = found.setdefault(int(text_of[i]), ([], set()))
                spans.append((int(i - first[text_of[i]]), int(i - first[text_of[i]]) + size))
                own.add(own_set)
            old_hits, old_sets = batch.column(n_cols - 2).to_pylist(), batch.column(n_cols - 1).to_pylist()
            hits, sets = [], []
            for k in range(len(texts)):
                spans, own = found.get(k, ((), ()))
                spans = [*spans, *((x["start"], x["end"]) for x in old_hits[k] or ())]
                hits.append([{"start": a, "end": b} for a, b in _merge(spans)])
                sets.append(sorted({*own, *(old_sets[k] or ())}))
            columns = batch.columns[:n_cols - 3] + [pa.array(last - first, pa.int64()), pa.array(hits, _HITS_ARROW),
                                                    pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return step


def _n_hit(hits: str):
    return F.aggregate(F.col(hits), F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    windows, members = item_sets(written(benchmark_windows(benchmark, width), "benchmark-windows"))
    plain = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    marked, n_words, hits, sets = mark(plain, windows, "text", block_windows)
    judged = written(marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(n_words).alias("n_words"),
                                   _n_hit(hits).alias("n_hit"), F.col(sets).alias("sets")), "marked-documents")
    items = (judged.select("row", F.explode("sets").alias("set")).join(members, "set").groupBy("row")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    own = F.coalesce("items", F.array().cast("array<string>"))
    return judged.join(items, "row", "left").select(
        "doc_id", "n_words", "n_hit", F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (CONTAMINATED_SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text",
                  width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents (``mode="documents"``; every other row stays
    as it is), or with the hit word spans cut out of every text (``mode="spans"``)."""
    windows = written(benchmark_windows(benchmark, width).select("size", "hash", "gram").distinct(), "benchmark-windows")
    marked, n_words, hits, _ = mark(docs, windows.withColumn("set", F.lit(0).cast("long")), text_col, block_windows)
    if mode == "documents":
        n_hit = _n_hit(hits)
        return marked.where(~((n_hit > 0) & (CONTAMINATED_SHARE * n_hit >= F.col(n_words)))).select(*map(quoted, docs.columns))
    if mode != "spans":
        raise ValueError(f"mode {mode!r}: documents or spans")
    at, n = docs.columns.index(text_col), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in X.blocks(batches, at):
            kept = []
            for t, spans in zip(texts, batch.column(n + 1).to_pylist()):
                if spans:
                    s, e = X.Texts([t]).words(X.ALNUM_WORD)
                    edge = [0, *(x for p in spans for x in (int(s[p["start"]]), int(e[p["end"] - 1]))), len(t)]
                    t = b"".join(t[edge[k]:edge[k + 1]] for k in range(0, len(edge), 2))
                kept.append(t)
            columns = list(batch.columns[:n])
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n])

    schema = T.StructType([T.StructField(f.name, T.StringType() if k == at else f.dataType, True)
                           for k, f in enumerate(docs.schema.fields)])
    return map_arrow(marked, cut, schema)
