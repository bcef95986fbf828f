"""Token ids of a corpus as entropy-coded files in document order.

1. Texts are dealt out by ranges of the document id, sorted, encoded, and their ids
   written to the shared folder: ``(part, seq)`` is the global order.
2. Tasks count their ids and Spark adds the counts up, over all documents; at most one row
   for each token of the vocabulary reaches the driver, which scales them to the one
   frequency table that all blocks share.
3. Tasks gather whole documents into segments of about ``SEGMENT_TOKENS`` ids and code them
   (:mod:`.rans`).  Spark's text writer puts the segments into files, its line separator
   after each; the model is a file of its own beside them.
4. Reading back, each file is one task's; every segment decodes alone, from all its
   checkpoints in parallel.  Running sums by part, and one total for each part on the
   driver, give every document its place in the whole stream.

Edge cases: a null or empty text is the end id alone; documents come in the order of their
ids, a null id first, ties by text; repeated rows are documents of their own; other columns
are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rans
from . import text as X
from . import tokens as K
from .shared import map_arrow, new_path, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEGMENT_TOKENS = 4 << 20
TOKEN_BLOCK_BYTES = 4 << 20
SEPARATOR = "\n"


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Rows ``(part, seq, doc_id, ids)`` in global order; ``ids`` are little-endian 16-bit (32-bit
    for a larger vocabulary) with the end id."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").select(F.col("doc_id").cast("string"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = K.encoder(tokenizer or K.public(TOKENIZER))
        kind = _kind(coder.tokenizer.get_vocab_size())
        part, seq = TaskContext.get().partitionId(), 0
        for batch, texts in X.blocks(batches, 1, TOKEN_BLOCK_BYTES):
            ids, counts = coder.encode(texts)
            stops = np.cumsum(counts)
            rows = np.insert(ids, stops, end_id).astype(kind)
            offsets = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)]) * rows.itemsize
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(rows)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), part, np.int64)), pa.array(np.arange(seq, seq + len(texts))), batch.column(0), blob.cast(pa.binary())],
                names=["part", "seq", "doc_id", "ids"])
            seq += len(texts)

    return map_arrow(dealt, encode, "part long, seq long, doc_id string, ids binary")


def _kind(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and the number of each row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(offsets) // kind.itemsize


def fit(tokens: DataFrame, vocabulary: int) -> rans.Model:
    """The frequency table of all ids."""
    kind = _kind(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocabulary, np.int64)
        for batch in batches:
            sums += np.bincount(_flat(batch.column(0), kind)[0], minlength=vocabulary)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], names=["token", "n"])

    got = map_arrow(tokens.select("ids"), count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[got.column("token").to_numpy()] = got.column("n").to_numpy()
    return rans.Model.of_counts(counts)


def segments(tokens: DataFrame, model: rans.Model, vocabulary: int, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Coded segments of whole documents, in the column ``value``."""
    kind, shared = _kind(vocabulary), tokens.sparkSession.sparkContext.broadcast(model.to_bytes())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rans.Model.from_bytes(shared.value)
        names, lengths, parts, at, size = [], [], [], None, 0

        def flush() -> pa.RecordBatch:
            data = rans.encode(own, np.concatenate(parts), names, np.array(lengths, np.int64), *at)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            ids, sizes = _flat(batch.column(3), kind)
            stops = np.cumsum(sizes)
            for part, seq, name, n, stop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                batch.column(2).to_pylist(), sizes.tolist(), stops.tolist()):
                if names and (part != at[0] or seq != at[1] + len(names) or size + n > segment_tokens):
                    yield flush()
                    names, lengths, parts, size = [], [], [], 0
                if not names:
                    at = (part, seq)
                names.append(None if name is None else name.encode())
                lengths.append(n)
                parts.append(ids[stop - n:stop])
                size += n
        if names:
            yield flush()

    return map_arrow(tokens.select("part", "seq", "doc_id", "ids"), code, "value binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """``path/model`` and ``path/segments``: the coded ids of all documents."""
    spark = docs.sparkSession
    vocabulary = max(K.encoder(tokenizer or K.public(TOKENIZER)).tokenizer.get_vocab_size(), end_id + 1)
    tokens = written(tokenized(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    model = fit(tokens, vocabulary)
    as_text = lambda df: df.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR)
    as_text(spark.createDataFrame([(bytearray(model.to_bytes()),)], "value binary").coalesce(1)).text(f"{path}/model")
    as_text(segments(tokens, model, vocabulary)).text(f"{path}/segments")


def read_model(spark: SparkSession, path: str) -> rans.Model:
    files = spark.read.format("binaryFile").load(f"{path}/model").where("length > 0").select("content").collect()
    return rans.Model.from_bytes(bytes(files[0]["content"]))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rows ``(part, first, before, doc_id, n_tokens, ids_crc32)`` and, if ``with_ids``, ``ids``, decoded
    from the files; ``before`` counts the ids of its segment's documents before it."""
    shared = spark.sparkContext.broadcast(read_model(spark, path).to_bytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rans.Model.from_bytes(shared.value)
        for batch in batches:
            for content in batch.column(0):
                for data in rans.split(memoryview(content.as_buffer()), SEPARATOR.encode()):
                    part, first, names, lengths, ids = rans.decode(model, data)
                    stops, ids = np.cumsum(lengths), ids.astype("<u4")
                    cut = [ids[b - n:b] for n, b in zip(lengths.tolist(), stops.tolist())]
                    n = len(names)
                    columns = [pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, first, np.int64)), pa.array(stops - lengths),
                               pa.array([None if x is None else x.decode() for x in names], pa.string()), pa.array(lengths),
                               pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=names_out)

    schema = "part long, first long, before long, doc_id string, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names_out = [x.strip().split()[0] for x in schema.split(",")]
    files = spark.read.format("binaryFile").load(f"{path}/segments").where("length > 0").select("content")
    return map_arrow(files, read, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
                path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    read = written(read_documents(spark, path), "token-documents")
    sizes = written(read.groupBy("part", "first").agg(F.sum("n_tokens").alias("n")), "token-segments")
    totals = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:                      # one row for each part
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, T.StructType([T.StructField("part", T.LongType()), T.StructField("base", T.LongType())]))
    earlier = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("in_part")).join(bases, "part")
              .select("part", "first", (F.col("base") + F.col("in_part")).alias("segment_start")))
    return read.join(starts, ["part", "first"]).select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), (F.col("segment_start") + F.col("before")).alias("start"),
        "n_tokens", "ids_crc32")
