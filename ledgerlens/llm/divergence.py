"""Source divergence audit: how far the term use of each source is from others of its language.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a language keeps the terms of
at least ``min_docs`` of its documents.  All arithmetic is on whole numbers.

1. Arrow compute in tasks (``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode``, hash
   ``group_by``) turns each block of texts into partial counts by language, source and term;
   counts of several blocks are merged until a task holds ``HELD_ROWS`` of them.
2. Spark adds them up, one partition for all sources of a term; a window over the term finds
   its documents in the language and drops rare terms.  The merged counts are a table.
3. Totals by group and language, a row for each, join the merged counts as header rows of the
   parts that terms are dealt to.  A part is read in order of language and term: its counts
   become columns, one for each source, of at most ``CELLS`` cells at a time, from which shares
   and divergences of all sources follow.  Sums and best terms of the parts meet in Spark.

Shares are ``1 + floor(10**9 * (count + 2) / (N + 2 * V))``; a divergence is
``floor((p - q)**2 / (p + q))``, added up over terms.

Edge cases: a null language, source or text is read as empty; a group without terms occurs
with its default shares; a language without kept terms has divergences of 0; repeated rows
are documents of their own; ties go by the item's UTF-8 bytes; an empty table gives an empty
result; other columns are not read.  The result has a row for each ordered pair of
sources of a language: it grows with the square of a language's sources, as asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, written

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 10 ** 9                  # shares are whole parts of this
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

BLOCK_BYTES = 4 << 20            # of text to split at a time
HELD_ROWS = 1 << 19              # partial counts that a task holds
CELLS = 1 << 20                  # counts in columns at a time
PARTS_A_PARTITION = 4            # parts of the terms for each shuffle partition, dealt out by hash


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BLOCK_BYTES`` of the column's text, one row at least."""
    total = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, total[i] + BLOCK_BYTES, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _block_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """Rows ``(lang, source, term, c, docs)`` of a block; each group also has a row without term."""
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    width = max(len(source.dictionary), 1)
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BREAKS)
    doc, term = pc.list_parent_indices(split), pc.list_flatten(split)
    full = pc.not_equal(term, "")
    doc, term = doc.filter(full), term.filter(full).dictionary_encode()
    by_doc = pa.table({"doc": doc, "term": term.indices}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    by_group = (pa.table({"group": pa.array(group).take(by_doc["doc"]), "term": by_doc["term"], "c": by_doc["count_all"]})
                .group_by(["group", "term"], use_threads=False).aggregate([("c", "sum"), ("c", "count")]))
    bare = np.unique(group)
    groups = np.concatenate([by_group["group"].to_numpy(), bare])
    none = np.zeros(len(bare), np.int64)
    return pa.table({"lang": lang.dictionary.take(pa.array(groups // width)), "source": source.dictionary.take(pa.array(groups % width)),
                     "term": pa.concat_arrays([term.dictionary.take(by_group["term"].combine_chunks()), pa.nulls(len(bare), pa.string())]),
                     "c": pa.array(np.concatenate([by_group["c_sum"].to_numpy(), none])),
                     "docs": pa.array(np.concatenate([by_group["c_count"].to_numpy(), none]))})


def _merged(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    return (pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("c", "sum"), ("docs", "sum")])
            .select([*keys, "c_sum", "docs_sum"]).rename_columns([*keys, "c", "docs"]))


def partial_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows ``(lang, source, term, c, docs)``: occurrences and documents, several rows a key."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for piece in _slices(batch, 2):
                held.append(_block_counts(*piece.columns))
                if sum(t.num_rows for t in held) > HELD_ROWS:
                    held = [_merged(held)]
                    if held[0].num_rows > HELD_ROWS // 2:
                        yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _merged(held).to_batches(1 << 16)

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return map_arrow(plain, count, "lang string, source string, term string, c long, docs long")


def kept_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows ``(lang, source, term, c, total, first)``, a table in the shared folder: occurrences in the
    group and in the language, and whether this is the term's first source.  Each group also
    has a row without term."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = (partial_counts(docs, text_col, lang_col, source_col).repartition(parts, "lang", "term")
             .groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    kept = (added.withColumn("in_lang", F.sum("docs").over(term)).withColumn("total", F.sum("c").over(term))
            .withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
            .where(F.col("term").isNull() | (F.col("in_lang") >= min_docs)))
    return written(kept.select("lang", "source", "term", "c", "total", "first"), "divergence-counts")


def _shares(count: np.ndarray, n: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (n + 2 * terms))`` by long division, three digits at a time:
    exact for counts up to 10**15."""
    rest, all_ = (count + 2).astype(np.uint64), (n + 2 * terms).astype(np.uint64)
    out = np.zeros(np.broadcast(rest, all_).shape, np.uint64)
    if not out.size:
        return out.astype(np.int64)
    out, rest = out + rest // all_, rest % all_
    for _ in range(3):
        rest = rest * np.uint64(1000)
        out, rest = out * np.uint64(1000) + rest // all_, rest % all_
    return out.astype(np.int64) + 1


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = (p - q).astype(np.uint64)            # squares of differences modulo 2**64 are those of their sizes
    return (d * d // (p + q).astype(np.uint64)).astype(np.int64)


class _Language:
    """What a partition gathers of one language."""

    def __init__(self, name: str, top_terms: int):
        self.name, self.top_terms = name, top_terms
        self.headers: list[pa.Table] = []
        self.sources: pa.Array | None = None
        self.pending: list[pa.Table] = []

    def _open(self) -> None:
        head = pa.concat_tables(self.headers).group_by(["source"], use_threads=False).aggregate([("c", "max"), ("terms", "max"), ("in_lang", "max")]).sort_by("source")
        self.sources = head["source"].combine_chunks()
        self.n, self.terms, self.in_lang = head["c_max"].to_numpy(), int(head["terms_max"][0].as_py()), head["in_lang_max"].to_numpy()[:1]
        self.sums = np.zeros((len(head), len(head)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in range(len(head))]

    def add(self, rows: pa.Table) -> None:
        """Rows in order of term; those of the last term wait for the next call."""
        self.pending.append(rows)
        if sum(t.num_rows for t in self.pending) > CELLS:
            rows = pa.concat_tables(self.pending)
            cut = pc.index(rows["term"], rows["term"][-1]).as_py()
            self.pending = [rows.slice(cut)]
            self._columns(rows.slice(0, cut))

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.sources is None:
            self._open()
        if self.pending:
            self._columns(pa.concat_tables(self.pending))
        size = len(self.sources)
        for i in range(size):
            both = np.concatenate([self.sums[:i, i], self.sums[i, i + 1:]])
            yield self._rows(i, "pair", self.sources.take(pa.array(np.delete(np.arange(size), i))), pa.array(both))
            yield self._rows(i, "term", pa.array([t for _, t in self.best[i]], pa.string()), pa.array([-v for v, _ in self.best[i]], pa.int64()))

    def _rows(self, i: int, part: str, items: pa.Array, values: pa.Array) -> pa.RecordBatch:
        fill = lambda x: pa.array([x] * len(items), pa.string())
        return pa.RecordBatch.from_arrays([fill(self.name), fill(self.sources[i].as_py()), fill(part), items, values],
                                          names=["lang", "source", "part", "item", "value"])

    def _columns(self, rows: pa.Table) -> None:
        if self.sources is None:
            self._open()
        at = pc.index_in(rows["source"], value_set=self.sources).to_numpy()
        term = rows["term"].combine_chunks().dictionary_encode()
        index, c, total = term.indices.to_numpy(), rows["c"].to_numpy(), rows["total"].to_numpy()
        size = len(self.sources)
        step = max(1, CELLS // max(size, 1))
        for low in range(0, len(term.dictionary), step):
            words = term.dictionary.slice(low, step)
            a, b = np.searchsorted(index, [low, low + len(words)])
            counts, totals = np.zeros((len(words), size), np.int64), np.zeros((len(words), 1), np.int64)
            counts[index[a:b] - low, at[a:b]] = c[a:b]
            totals[index[a:b] - low, 0] = total[a:b]
            p, q = _shares(counts, self.n[None, :], self.terms), _shares(totals, self.in_lang[None, :], self.terms)
            for i in range(size - 1):
                self.sums[i, i + 1:] += _divergences(p[:, i:i + 1], p[:, i + 1:]).sum(axis=0)
            above = np.where((counts > 0) & (p > q), _divergences(p, q), -1)
            for i in range(size):
                self._best_of(i, above[:, i], words)

    def _best_of(self, i: int, values: np.ndarray, words: pa.Array) -> None:
        at = np.flatnonzero(values >= 0)
        if len(at) > self.top_terms:
            least = np.partition(values[at], len(at) - self.top_terms)[len(at) - self.top_terms]
            at = at[values[at] >= least]
            at = at[np.lexsort((at, -values[at]))][:self.top_terms]      # terms come in order of their bytes
        found = list(zip((-values[at]).tolist(), words.take(pa.array(at)).to_pylist()))
        self.best[i] = sorted(self.best[i] + found)[:self.top_terms]


def _audit(top_terms: int):
    """A map step over rows ``(lang, kind, term, source, c, total, terms, in_lang)`` in this order: a
    language's header rows (kind 0), then its counts."""
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Language | None = None
        for batch in batches:
            names, kind = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = names.indices.to_numpy()
            edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if b == a:
                    continue
                name = names.dictionary[int(code[a])].as_py()
                if now is None or now.name != name:
                    if now is not None:
                        yield from now.close()
                    now = _Language(name, top_terms)
                rows = pa.Table.from_batches([batch.slice(a, b - a)])
                now.headers.append(rows) if kind[a] == 0 else now.add(rows)
        if now is not None:
            yield from now.close()

    return audit


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                     min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``: part ``pair`` has each other source of the
    language and the divergence from it, part ``term`` the ``top_terms`` terms that the source uses more
    than its language, by divergence."""
    spark = docs.sparkSession
    counts = kept_counts(docs, text_col, lang_col, source_col, min_docs)
    groups = counts.groupBy("lang", "source").agg(F.sum("c").alias("c"))
    langs = counts.groupBy(F.col("lang").alias("in_group")).agg(
        F.sum(F.when(F.col("first") & F.col("term").isNotNull(), 1).otherwise(0)).alias("terms"), F.sum("c").alias("in_lang"))
    parts = PARTS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    heads = groups.join(langs, F.col("lang") == F.col("in_group")).select(
        "lang", F.lit(0).alias("kind"), none.alias("term"), "source", "c", zero.alias("total"), "terms", "in_lang", part)
    rows = counts.where(F.col("term").isNotNull()).select(
        "lang", F.lit(1).alias("kind"), "term", "source", "c", "total", zero.alias("terms"), zero.alias("in_lang"),
        F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part"))
    dealt = heads.union(rows).repartition(parts // PARTS_A_PARTITION, "part").sortWithinPartitions("lang", "kind", "term", "source").drop("part")
    found = map_arrow(dealt, _audit(top_terms), "lang string, source string, part string, item string, value long")
    added = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return added.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
