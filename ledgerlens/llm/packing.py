"""Best-fit packing of token sequences.

Best-fit decreasing over all documents at once: items in descending length, each into the
open bin with the least room that still takes it.  Lengths are whole numbers from 1 to
``capacity``, so equal lengths are interchangeable and so are bins with equal room: the
state is one count for each length and one for each remaining capacity, whatever the
corpus holds.  A segment tree over the remaining capacities finds the tightest open bin in
logarithmic time; all items of one length that the plain algorithm would send one by one
to bins of one class go there as one range of ranks and bins.

1. A map step encodes each text, cuts longer ones into pieces and numbers the pieces of
   each length within its task; the pieces are written to the shared folder.
2. Spark counts pieces by length (at most ``capacity`` rows reach the driver) and by
   length and task; running sums of the latter turn task numbers into ranks.
3. The plan, a table of rank ranges by length, is broadcast; its size depends on
   ``capacity`` alone.  Each piece reads its bin and offset from its range.

Edge cases: a null or empty text is one piece that holds the end id alone; repeated rows
and null ids are pieces of their own; ties among equal lengths go by input order.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from . import tokens as K
from .shared import map_arrow, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
TOKEN_BLOCK_BYTES = 4 << 20


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, part, place)`` and, if ``with_ids``,
    ``ids``; ``place`` numbers the pieces of one length within one task (``part``)."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "part", "place")),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = K.encoder(tokenizer or K.public(TOKENIZER), True)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, texts in X.blocks(batches, 1, TOKEN_BLOCK_BYTES):
            ids, counts = coder.encode(texts)
            after = np.cumsum(counts)
            doc, piece, start, length, crc, place, own = [], [], [], [], [], [], []
            for k, (n, stop) in enumerate(zip(counts.tolist(), after.tolist())):
                seq = np.append(ids[stop - n:stop], np.uint32(end_id))
                for p, at in enumerate(range(0, n + 1, capacity)):
                    cut = seq[at:at + capacity]
                    doc.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut))
                    place.append(int(seen[len(cut)]))
                    seen[len(cut)] += 1
                    if with_ids:
                        own.append(cut.astype(np.int32))
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                       *(pa.array(c, pa.int64()) for c in (start, length, crc, [part] * len(doc), place))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.list_(pa.int32()))] if with_ids else []),
                                             names=schema.names)

    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), encode, schema)


class Room:
    """Open bins by remaining capacity: a segment tree of whether a class has bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.bins: list[deque] = [deque() for _ in range(capacity + 1)]

    def _set(self, room: int, value: bool) -> None:
        k = self.leaves + room
        self.some[k] = value
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def tightest(self, length: int) -> int | None:
        """The least class of at least ``length`` that has an open bin."""
        k = self.leaves + length
        while not self.some[k]:
            while k & 1:                       # climb to the first ancestor with a right sibling
                k //= 2
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.some[2 * k] else 2 * k + 1
        return k - self.leaves

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.bins[room].append((first, n))
            self._set(room, True)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` neighbouring bins of a class: first bin and how many."""
        first, n = self.bins[room].popleft()
        if n > most:
            self.bins[room].appendleft((first + most, n - most))
            n = most
        if not self.bins[room]:
            self._set(room, False)
        return first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` items: ranges ``(length, first rank, items a
    bin, first bin, offset)``; a range ends where the next of its length begins."""
    room, opened, out = Room(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = room.tightest(length)
            size = capacity if r is None else r
            each = min(left, size // length)   # a bin of the tightest class stays the tightest until it is full
            if r is None:
                first, n = opened, left // each
                opened += n
            else:
                first, n = room.take(r, left // each)
            out.append((length, rank, each, first, capacity - size))
            room.put(size - each * length, first, n)
            rank, left = rank + n * each, left - n * each
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).
    Pieces of a sequence lie gapless from offset 0; no sequence is longer than ``capacity``."""
    spark = docs.sparkSession
    items = written(pieces(docs, capacity, tokenizer, end_id, id_col, text_col, with_ids), "pieces")
    dealt = items.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {int(r["length"]): int(r["n"]) for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    ranked = items.join(base, ["length", "part"]).select(
        *[c for c in items.columns if c not in ("part", "place")], (F.col("place") + F.col("base")).alias("rank"))
    out = T.StructType([*(f for f in ranked.schema.fields if f.name not in ("rank", "ids")),
                        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
                        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        starts = np.searchsorted(ranges[:, 0], np.arange(capacity + 2))
        key = ranges[:, 0] * (1 << 48) + ranges[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            k = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            assert (k >= starts[length]).all()
            step = rank - ranges[k, 1]
            each = ranges[k, 2]
            found = {"sequence_id": pa.array(ranges[k, 3] + step // each),
                     "offset": pa.array(ranges[k, 4] + step % each * length)}
            yield pa.RecordBatch.from_arrays(
                [found[n] if n in found else batch.column(batch.schema.get_field_index(n)) for n in out.names], names=out.names)

    return map_arrow(ranked, assign, out).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
