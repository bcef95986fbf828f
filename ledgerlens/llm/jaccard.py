"""Exact similarity self-join on word shingles: a grouped prefix join.

A document's set holds its distinct five-word shingles (64-bit hashes).  Two sets can only
reach the threshold when they share a shingle among the first ``n - ceil(t n) + 1`` of each,
in any order that is the same for all: here shingles seen often come last (at most
``FREQUENT`` of them, most frequent at the very end), all others go by hash.

1. Equal sets are one class; classes with equal prefix and size are one group.  Groups are
   what the index holds, copies never meet one by one.
2. The index: tasks send their prefixes, a class once for each task, as arrays by bucket of
   the shingle; each bucket sorts its arrays and keeps the shingles that two or more share.
3. Group pairs are filtered by size and by the places of the shingle they share (all shingles
   before it in either set are not common, so it bounds the overlap), then expanded into members and verified on whole sets,
   in two rounds.  First every list is held against its first group, and each group against
   its first member: large families of near copies become connected with one comparison a
   member and list.  Then only members of different components that share a list are
   compared.  A pair that neither round compares is connected already, so components are
   exact, and no family of copies is expanded into all its pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer than five words is
one shingle.  Ids are whole numbers below 2**62.  Edge cases: null, empty and blank texts have
an empty set and link with nothing; repeated rows and equal texts are copies; rows that share
an id are one node of the graph; rows with a null id and equal texts share a node that counts as
larger than all ids, and their component is null unless it holds a row with an id; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .graph import components
from .shared import map_arrow, quoted, written

SHINGLE = 5
PERCENT = 80
FREQUENT = 500_000               # shingles that may go last, at most; 16 bytes each are broadcast
FREQUENT_LEAST = 8               # documents, as far as tasks see them, that make a shingle frequent
HELD_SHINGLES = 1 << 22          # shingles that a task holds before it hands on what it has of them
BROADCAST_IDS = 1_000_000        # up to so many ids of candidates are broadcast to the texts, more are joined by a shuffle

_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one after another, and the number of each."""
    block = X.Texts(texts)
    s, e = block.words(X.SPACED_WORD)
    h = X.hash_words(block.buf, s, e)
    first, last = block.owner(s)
    w = X.hash_windows(h, size)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            out.append(np.unique(w[a:b - size + 1]))
        else:
            out.append(X.hash_windows(h[a:b], b - a, seed=b - a + 1) if b > a else w[:0])
    return np.concatenate(out) if out else w[:0], np.fromiter(map(len, out), np.int64, len(out))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Order:
    """The order of shingles: frequent ones last, by rising frequency; the rest by hash."""

    def __init__(self, frequent: np.ndarray):
        self.keys = np.sort(frequent)
        self.rank = np.empty(len(frequent), np.int64)
        self.rank[np.searchsorted(self.keys, frequent)] = np.arange(len(frequent))
        self.shift = np.uint64(40)
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[self.keys >> self.shift] = True

    def prefixes(self, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[np.ndarray]:
        rank = np.full(len(flat), -1, np.int64)
        at = np.flatnonzero(self.maybe[flat >> self.shift])
        if len(self.keys) and len(at):
            k = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
            hit = self.keys[k] == flat[at]
            rank[at[hit]] = self.rank[k[hit]]
        out = []
        for n, stop in zip(sizes.tolist(), np.cumsum(sizes).tolist()):
            s, r = flat[stop - n:stop], rank[stop - n:stop]
            if n and r.max() >= 0:
                s = s[np.argsort(r, kind="stable")]
            out.append(s[:prefix_length(n, percent)])
        return out


_NO_ID = 1 << 62                # nodes of rows without an id start here


def _node(id_col: str, text_col: str) -> Column:
    own = F.xxhash64(F.col(quoted(text_col)).cast("string")).bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID))
    return F.coalesce(F.col(quoted(id_col)).cast("long"), own)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_node(id_col, text_col).alias("doc"), F.col(quoted(text_col)).cast("string").alias("text"))


def frequent_shingles(plain: DataFrame, size: int, most: int) -> np.ndarray:
    """Shingles that tasks met in two or more of their documents, by rising number of documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for _, texts in X.blocks(batches, 1):
            seen.append(shingle_sets(list(dict.fromkeys(texts)), size)[0])     # copies within a block count once
            if sum(map(len, seen)) >= HELD_SHINGLES:
                yield from counted(seen)
        if seen:
            yield from counted(seen)

    def counted(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(seen)
        seen.clear()
        flat.sort()
        at = 0
        while at < len(flat):                      # slices that end between two shingles
            stop = int(np.searchsorted(flat, flat[min(at + (1 << 19), len(flat) - 1)], side="right"))
            part = flat[at:stop]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            n = np.diff(edge)
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1][n > 1]].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "n"])
            at = stop

    got = (map_arrow(plain, count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "shingle").limit(most).toArrow())
    return got.column("shingle").to_numpy().view(np.uint64)[::-1].copy()


def _summary(plain: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """Rows ``(doc, n, k1, k2, pk)``: set size, two sums that name the set, one that names its prefix."""
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(shared.value)
        for batch, texts in X.blocks(batches, 1):
            flat, sizes = shingle_sets(texts, size)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            sums = []
            for salt in _SALTS[:2]:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix64(flat ^ salt))])
                sums.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
            prefix = [int(X.mix64(p ^ _SALTS[2]).sum(dtype=np.uint64)) for p in order.prefixes(flat, sizes, percent)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, sums),
                                              pa.array(np.array(prefix, np.uint64).view(np.int64))], names=["doc", "n", "k1", "k2", "pk"])

    return map_arrow(plain, summarize, "doc long, n long, k1 long, k2 long, pk long")


def _shared_prefixes(plain: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """Rows ``(token, doc, pos)`` of the prefix shingles that two or more sent documents have;
    ``pos`` is the shingle's place in the document's set, from 0."""
    buckets = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, tokens, owners, places, done, held = Order(shared.value), [], [], [], set(), 0
        for batch, texts in X.blocks(batches, 1):
            flat, sizes = shingle_sets(texts, size)
            docs = batch.column(0).to_pylist()
            for doc, p, n, stop in zip(docs, order.prefixes(flat, sizes, percent), sizes.tolist(), np.cumsum(sizes).tolist()):
                s = flat[stop - n:stop]
                key = (n, *(int(X.mix64(s ^ salt).sum(dtype=np.uint64)) for salt in _SALTS[:2]))
                if n and key not in done:
                    done.add(key)
                    tokens.append(p)
                    owners.append(np.full(len(p), doc, np.int64))
                    places.append(np.arange(len(p), dtype=np.int32))
                    held += len(p)
                    if held >= HELD_SHINGLES // 4:
                        yield from dealt(tokens, owners, places)
                        held = 0
        if tokens:
            yield from dealt(tokens, owners, places)

    def dealt(*lists: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, d, k = map(np.concatenate, lists)
        for own in lists:
            own.clear()
        bucket = (t % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            own = by[edge[b]:edge[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([t[own].tobytes()], pa.binary()),
                                              pa.array([d[own].tobytes()], pa.binary()), pa.array([k[own].tobytes()], pa.binary())],
                                             names=["bucket", "tokens", "docs", "places"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[], [], []]
        for batch in batches:
            for own, column, kind in zip(got, batch.columns[1:], (np.uint64, np.int64, np.int32)):
                own += [np.frombuffer(x.as_buffer(), kind) for x in column]
        if not got[0]:
            return
        t, d, k = map(np.concatenate, got)
        by = np.argsort(t)
        t, d, k = t[by], d[by], k[by]
        same = t[1:] == t[:-1]
        kept = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        t, d, k = t[kept].view(np.int64), d[kept], k[kept]
        for i in range(0, len(t), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)]) for x in (t, d, k)], names=["token", "doc", "pos"])

    sent = map_arrow(plain, send, "bucket int, tokens binary, docs binary, places binary")
    return map_arrow(sent.repartition(buckets, "bucket"), meet, "token long, doc long, pos int")


def _verified(pairs: DataFrame, plain: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the threshold."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in X.blocks(batches, 1):
            flat, sizes = shingle_sets(texts, size)
            stops = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[b - n:b].tobytes() for n, b in zip(sizes.tolist(), stops.tolist())], pa.binary())],
                                             names=["doc", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                hold.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hold, pa.bool_()))

    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    ids = written(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct(), "candidates")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = written(map_arrow(plain.join(ids, "doc", "left_semi"), sets, "doc long, set binary").where("length(set) > 0"), "sets")
    with_a = pairs.join(own.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a")
    with_b = with_a.join(own.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    return map_arrow(with_b.select("a", "b", "set_a", "set_b"), compare, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                      percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """Per row ``doc_id, n_shingles, class_id`` (smallest id with the same set) and ``component_id``
    (smallest id reachable by links)."""
    found = _components(docs, id_col, text_col, size, percent, frequent)
    known = lambda c: F.when(F.col(c) < _NO_ID, F.col(c)).alias(c)
    return found.select(known("doc_id"), "n_shingles", known("class_id"), known("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, frequent: int) -> DataFrame:
    spark = docs.sparkSession
    plain = _plain(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(frequent_shingles(plain, size, frequent))
    summary = written(_summary(plain, shared, size, percent), "summary")
    classes = summary.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc").alias("class"), F.first("pk").alias("pk"))
    groups = classes.groupBy("pk", "n").agg(F.min("class").alias("grp"))
    classes = written(classes.join(groups, ["pk", "n"]), "classes")
    members = written(summary.join(classes.drop("pk"), ["n", "k1", "k2"], "left").select("doc", "n", "class", "grp"), "members")

    # the index of groups: (token, grp, n), only tokens that two or more classes share
    index = written(_shared_prefixes(plain, shared, size, percent)
                    .join(members.where("class is not null").select("doc", "n", "class", "grp").distinct(), "doc")
                    .select("token", "grp", "n", "pos").distinct(), "index")
    firsts = index.groupBy("token").agg(F.min(F.struct("pos", "n", "grp")).alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # an overlap o reaches the threshold when (100 + percent) o >= percent (n + n2); past a common shingle's place there are n - pos at most
    fits = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= percent * (F.col("n") + F.col("n2"))
    group_pairs = (index.join(firsts, "token").select("grp", "n", "pos", F.col("head.grp").alias("grp2"), F.col("head.n").alias("n2"),
                                                      F.col("head.pos").alias("pos2"))
                   .where((F.col("grp") != F.col("grp2")) & fits).select("grp", "grp2").distinct())
    own = classes.select(F.col("class").alias("a"), "grp")
    first_round = (group_pairs.join(own, "grp").select("a", F.col("grp2").alias("b"))      # a group's id is its first member
                   .union(own.where("a <> grp").select("a", F.col("grp").alias("b"))))
    links = written(_verified(first_round.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), plain, size, percent), "links")

    linked = components(links)
    own = (classes.select("class", "grp", "n").join(linked, F.col("class") == F.col("node"), "left")
           .select("class", "grp", "n", F.coalesce("component", "class").alias("component")))
    lists = index.select("token", "grp", "pos").join(own, "grp")
    open_lists = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    left = written(lists.join(open_lists, "token").select("token", F.col("class").alias("a"), "n", "pos", "component"), "open-lists")
    right = left.select("token", F.col("a").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("component2"))
    second_round = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("component2")) & fits)
    all_links = links.union(written(_verified(second_round, plain, size, percent), "links"))
    final = components(all_links)
    return members.join(final, F.col("class") == F.col("node"), "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class", "doc").alias("class_id"),
        F.coalesce("component", "class", "doc").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id, as it is."""
    found = _components(docs, id_col, text_col, size, percent, FREQUENT)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = (docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), _node(id_col, text_col).alias("own"))
            .join(gone, F.col("own") == F.col("gone"), "left_anti"))
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1)
    if again.count():                           # rows that share a node are one document
        kept = kept.dropDuplicates(["own"])
    return kept.select("row.*")
