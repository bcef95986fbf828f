"""Removal of repeated byte strings by column-wise construction over many documents.

A byte goes when a ``LENGTH``-byte string that covers it also starts in a document with a
smaller id.  Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

Dealing out.  Every ``LENGTH``-byte window selects an anchor: the ``GRAM`` bytes of least hash
within it.  Neighbouring windows with one anchor are a piece.  Equal windows select equal
anchors at equal places, so pieces dealt out by their anchor's hash bring all equal windows
together, aligned: column 0 of each piece is its anchor.  Within a chunk of texts equal
pieces travel once, for the smallest id; the same piece of a larger id is marked at once.  A
task also remembers pieces of earlier chunks, those met again and again for good, so a
passage of very many documents sends about one copy a task, not one a chunk, to its anchor.
What a task forgets (it remembers ``SEEN_PIECES`` at most) travels again: results are the same.

Construction.  A task takes its pieces as a collection of aligned strings, anchor by anchor,
and builds the suffix order from the last column to the first, one symbol of each piece a
round: the symbols of a column in the order of the suffixes to their right are the
collection's Burrows-Wheeler transform of that round; a stable partition by symbol (its LF
mapping) gives the next order, and the common prefix of two neighbours is one more than the
least one between them in the round before.  Of earlier rounds only the order and common
prefixes of the last one are kept.  The pieces of a shard are the task's sequential input and
held packed; their columns are laid out for ``GROUP_PIECES`` at a time.  Neighbours that share ``LENGTH``
bytes are equal windows: those whose id is not the least of theirs are marked.

Marks, as byte spans, go back to their documents, merge, and the rest of each text is put
together.

Edge cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; rows with equal ids
never take bytes from each other; equal rows lose the same bytes; a null id counts as larger
than all others; ids are whole numbers; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import map_arrow, written

LENGTH = 50
GRAM = 12
CHUNK_BYTES = 1 << 20            # texts whose equal pieces travel once
SHARDS = 2                       # for each shuffle partition; a task holds the pieces of one shard
SEEN_PIECES = 1 << 19            # names that a task remembers at most, 25 bytes each
GROUP_PIECES = 50_000           # pieces built together, if one anchor does not have more

_NULL_ID = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)
_CODEC = pa.Codec("zstd", compression_level=5)


def _gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes that start at each byte."""
    return X.hash_windows(X._BYTE_CODES[buf], size, seed=3)


def pieces(block: X.Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of a block: text, first byte of the first and of the last window, byte of the anchor,
    hash of the anchor.  The block is under 2**24 bytes or one text, whose places wrap around."""
    h = _gram_hashes(block.buf, gram)
    span = length - gram + 1
    n = len(block.buf) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    out = []
    for at in range(0, n, 1 << 23):                # places count from here, in 24 bits
        m = min(n - at, 1 << 23)
        own = h[at:at + m + span - 1]
        least, size = own & ~_PLACE | np.arange(len(own), dtype=np.uint64), 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[:len(own) - span + 1], least[span - size:])
        out.append((least & _PLACE).astype(np.int64) + at)
    anchor = np.concatenate(out)
    # windows that end within their text
    room = np.maximum(block.ends - block.starts - length + 1, 0)
    first = X.ragged(block.starts, room)
    owner = np.repeat(np.arange(len(room)), room)
    a = anchor[first]
    opens = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])])) if len(a) else np.zeros(0, np.int64)
    closes = np.append(opens[1:], len(a)) - 1
    return owner[opens], first[opens], first[closes], a[opens], h[a[opens]]


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([x.nbytes for x in arrays], np.int64).tobytes()
    raw = sizes + b"".join(x.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


class Seen:
    """Least ids of the pieces that a task has met, by two hashes.  When it is full, pieces met once
    are forgotten first, and all others come one step nearer to that."""

    def __init__(self, most: int):
        self.most = most
        self.name, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.least, self.met = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def least_ids(self, name: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The least id so far of distinct pieces in order of ``name``, those of this chunk included."""
        at = np.searchsorted(self.name, name)
        known = np.zeros(len(name), bool)
        if len(self.name):
            here = np.minimum(at, len(self.name) - 1)
            known = (self.name[here] == name) & (self.check[here] == check)
            hit = here[known]
            self.met[hit] = np.minimum(self.met[hit], 254) + 1
            self.least[hit] = np.minimum(self.least[hit], ids[known])
        least = ids.copy()
        least[known] = self.least[at[known]]
        new = ~known
        for field, values in (("name", name), ("check", check), ("least", ids), ("met", np.ones(len(name), np.uint8))):
            setattr(self, field, np.insert(getattr(self, field), at[new], values[new]))
        if len(self.name) > self.most:
            keep = np.flatnonzero(self.met > 1)
            if len(keep) > self.most // 2:
                keep = np.sort(keep[np.argsort(self.met[keep], kind="stable")[-(self.most // 2):]])
            self.name, self.check, self.least, self.met = self.name[keep], self.check[keep], self.least[keep], self.met[keep] >> 1
        return least


_KINDS = (np.int64, np.int64, np.int32, np.int64, np.uint8, np.uint8, np.uint8, np.int32, np.int32, np.int32)


def _deal(shards: int, length: int, gram: int):
    """Map step: texts to rows ``(shard, data)``; ``data`` holds the ids and keys of the texts, the
    shard's pieces (text, byte, place of the anchor, size, bytes) and marks found at once."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(SEEN_PIECES)
        for batch, texts in X.blocks(batches, 2, CHUNK_BYTES):
            ids = np.array([_NULL_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            keys = batch.column(1).to_numpy()
            block = X.Texts(texts)
            owner, s, last, a, h = pieces(block, length, gram)
            if not len(s):
                continue
            size = last - s + length
            # equal pieces: equal bytes by hash, equal anchors, equal sizes
            names = [X.hash_words(block.buf, s, s + size, fold=False), h ^ size.astype(np.uint64)]
            by = np.lexsort((ids[owner], names[1], names[0]))
            new = np.concatenate([[True], (names[0][by][1:] != names[0][by][:-1]) | (names[1][by][1:] != names[1][by][:-1])])
            least = np.empty(len(s), np.int64)
            head = by[np.flatnonzero(new)]
            least[by] = seen.least_ids(names[0][head], names[1][head], ids[owner[head]])[np.cumsum(new) - 1]
            sent = ids[owner] == least
            shard = (X.mix64(h) % np.uint64(shards)).astype(np.int64)
            own_start = s - block.starts[owner]
            deal = np.lexsort((np.arange(len(s)), shard))
            edges = np.searchsorted(shard[deal], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                of = deal[edges[k]:edges[k + 1]]
                p, m = of[sent[of]], of[~sent[of]]
                docs, index = np.unique(owner[of], return_inverse=True)
                ip, im = index[sent[of]].astype(np.int32), index[~sent[of]].astype(np.int32)
                blob = _pack(ids[docs], keys[docs], ip, own_start[p], (a[p] - s[p]).astype(np.uint8), size[p].astype(np.uint8),
                             block.buf[X.ragged(s[p], size[p])], im, own_start[m].astype(np.int32), size[m].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "data"])
    return step


def equal_windows(columns: np.ndarray, valid: np.ndarray, ids: np.ndarray, length: int, rounds: int) -> Iterator[tuple[int, np.ndarray]]:
    """Column-wise construction over aligned strings ``columns[column, string]``.  For each of the
    first ``rounds`` columns: the strings whose window that starts there is valid and also starts
    there in a valid string with a smaller id."""
    n = columns.shape[1]
    order, common = np.arange(n), np.zeros(n, np.uint8)      # common[i]: of the i-th suffix and the one before it
    for c in range(len(columns) - 1, -1, -1):
        symbols = columns[c][order]                            # this round's Burrows-Wheeler transform
        step = np.argsort(symbols, kind="stable")
        least = np.minimum.reduceat(np.append(common, np.uint8(0)), step + 1)
        symbols = symbols[step]
        common = np.zeros(n, np.uint8)
        np.minimum(least[:-1], 254, out=least[:-1])
        common[1:] = np.where(symbols[1:] == symbols[:-1], least[:-1] + 1, 0)
        order = order[step]
        if c < rounds:
            equal = common >= length
            if equal.any():
                member = np.flatnonzero(equal | np.append(equal[1:], False))
                group = np.cumsum(~equal[member]) - 1
                strings = order[member]
                ok = valid[c, strings]
                own = np.where(ok, ids[strings], _NULL_ID)
                low = np.minimum.reduceat(own, np.flatnonzero(~equal[member]))
                marked = strings[ok & (own > low[group])]
                if len(marked):
                    yield c, marked


def _build(length: int, gram: int):
    """Reduce step: the pieces of a shard to rows ``(doc, key, start, end)`` of bytes to remove."""
    span = length - gram + 1

    def rows(ids, keys, start, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, keys, start.astype(np.int32), end.astype(np.int32))],
                                          names=["doc", "key", "start", "end"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        for batch in batches:
            for data in batch.column(1):
                ids, keys, ip, start, place, size, raw, im, m_start, m_size = _unpack(data.as_buffer().to_pybytes(), _KINDS)
                if len(im):
                    yield rows(ids[im], keys[im], m_start, m_start + m_size)
                if len(ip):
                    got.append([ids[ip], keys[ip], start, place, size, raw])
        if not got:
            return
        ids, keys, start, place, size, raw = (np.concatenate(x) for x in zip(*got))
        got.clear()
        at = np.cumsum(size.astype(np.int64)) - size
        h = np.zeros(len(at), np.uint64)
        for k in range(gram):
            h = X.mix64(h + X._BYTE_CODES[raw[at + place + k]])
        by = np.argsort(h)
        new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
        group = np.cumsum(new) - 1
        low = np.minimum.reduceat(ids[by], np.flatnonzero(new))
        high = np.maximum.reduceat(ids[by], np.flatnonzero(new))
        by, group = by[(low != high)[group]], group[(low != high)[group]]   # anchors of two or more documents
        del h, new, low, high
        while len(by):
            stop = len(by)
            if stop > GROUP_PIECES:                # whole anchors only
                stop = int(np.searchsorted(group, group[GROUP_PIECES], side="left")) or int(np.searchsorted(group, group[0], side="right"))
            own, by, group = by[:stop], by[stop:], group[stop:]
            shift = span - 1 - place[own].astype(np.int64)             # column 0 is the first byte that a window can start at
            columns = np.zeros((span - 1 + length, len(own)), np.uint8)
            for c in range(len(columns)):
                here = np.flatnonzero((c >= shift) & (c < shift + size[own]))
                columns[c, here] = raw[at[own[here]] + c - shift[here]]
            c = np.arange(span)[:, None]
            valid = (c >= shift) & (c <= shift + size[own].astype(np.int64) - length)
            marks = [(p, np.full(len(p), col)) for col, p in equal_windows(columns, valid, ids[own], length, span)]
            if marks:
                p, col = (np.concatenate(x) for x in zip(*marks))
                order = np.lexsort((col, p))
                p, col = p[order], col[order]
                edge = np.concatenate([[True], (p[1:] != p[:-1]) | (col[1:] != col[:-1] + 1)])
                first = np.flatnonzero(edge)
                last = np.append(first[1:], len(p)) - 1
                piece = own[p[first]]
                begin = start[piece] + col[first] - shift[p[first]]
                yield rows(ids[piece], keys[piece], begin, begin + col[last] - col[first] + length)

    return step


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows ``(doc, key, spans)``: byte spans to remove from the text with hash ``key`` of document
    ``doc`` (the largest number for a null id); spans may overlap."""
    shards = SHARDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    dealt = map_arrow(plain.where(F.octet_length("text") >= length), _deal(shards, length, gram), "shard int, data binary")
    marks = map_arrow(dealt.repartition(shards, "shard"), _build(length, gram), "doc long, key long, start int, end int")
    marks = written(marks, "marks")
    return marks.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row ``doc_id, n_bytes, kept`` (the remaining bytes) and ``removed``, the maximal runs taken out
    as ``struct<start, end>`` of bytes."""
    spans = repeated_spans(docs, id_col, text_col, length, gram)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = plain.join(spans, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)) == F.col("doc")) & (F.xxhash64("text") == F.col("key")),
                        "left").select("doc_id", "text", "spans")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("kept", T.BinaryType()),
                           T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in X.blocks(batches, 1):
            n_bytes, kept, removed = [], [], []
            for t, own in zip(texts, batch.column(2)):
                t = t or b""
                runs: list[dict] = []
                if own.is_valid:
                    a, b = (own.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    ends = b[np.append(first[1:], len(a)) - 1]
                    runs = [{"start": x, "end": y} for x, y in zip(a[first].tolist(), ends.tolist())]
                edge = [0, *(x for r in runs for x in (r["start"], r["end"])), len(t)]
                n_bytes.append(len(t))
                kept.append(b"".join(t[edge[k]:edge[k + 1]] for k in range(0, len(edge), 2)))
                removed.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, run)],
                                             names=schema.names)

    return map_arrow(joined, cut, schema)


def removal_digests(removed: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of what :func:`remove_repeats` returns."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                          F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
