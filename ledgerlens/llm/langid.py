"""Language identification with hyperdimensional profiles.

Every symbol (a lower-cased letter, or the gap between words) has a random vector of
``DIMENSIONS`` signs, drawn from a hash of its code point.  An n-gram's vector binds (multiplies) the
vectors of its symbols, each permuted (rotated) by its distance from the end; a text's vector
bundles (adds) those of all its n-grams, a language's prototype those of all its texts.  A text
is compared with the prototypes by cosine.

1. Tasks bundle the training texts by language; Spark adds the vectors up, whole numbers in
   ``WIDTH`` columns a row, so the result does not depend on the partitions.
2. Prototypes go to the tasks in groups of about ``GROUP_LANGUAGES``, whatever number of
   labels there is; a text keeps its best so far from one group to the next.  A group is a
   bounded broadcast; between two groups the table is written.

Signs are bits: binding is exclusive or, and a bundle of n vectors is n less twice the bits, a
matrix product of counts and bits over ``GRAMS`` n-grams at a time.

Training uses all labelled documents that ``held_out`` leaves, not a sample; a prediction sees the
text alone.  Edge cases: a null text or one without letters is ``und`` with score 0, as is
every text if nothing was learned; a null language is not learned from; a null id is not held
out; ties go to the smaller language; negative cosines score 0; very long texts are bundled in
pieces of ``PIECE`` characters; repeated rows are predicted alike; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import map_arrow, written

DIMENSIONS = 2048
SIZE = 3                         # symbols of an n-gram
UNKNOWN = "und"
WIDTH = 64                       # columns of a row of a prototype
GROUP_LANGUAGES = 2048           # prototypes in one broadcast, about
HELD_LANGUAGES = 512             # bundles that a training task holds
PIECE = 1 << 20
GRAMS = 4096

_GAP = 0
_LAST = 0x323B0                  # no letters beyond this code point


@functools.lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Code point -> lower-cased letter, or ``_GAP``."""
    out = np.zeros(_LAST + 1, np.uint32)
    for c in range(_LAST):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sign_bits(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """Random bits of each symbol, a row of ``dimensions`` zeros and ones."""
    seeds = X.mix64(symbols.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    words = X.mix64(seeds[:, None] + np.arange(1, dimensions // 64 + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little")


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and their texts' numbers, pieces of about ``PIECE`` characters; a text goes from gap to
    gap, runs of gaps are one, and a piece repeats the last symbols of the one before."""
    table = _symbols()

    def symbols(part: str) -> np.ndarray:
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        return table[np.minimum(points, _LAST)]

    def once(s: np.ndarray) -> np.ndarray:
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != _GAP) | (s[:-1] != _GAP)
        return keep

    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) + 2 <= PIECE):
            size += len(texts[j]) + 2
            j += 1
        if size > PIECE:                       # one long text
            carry = np.array([_GAP], np.uint32)
            for at in range(0, len(texts[i]) + 1, PIECE):
                part = texts[i][at:at + PIECE] + (" " if at + PIECE > len(texts[i]) else "")
                s = np.concatenate([carry, symbols(part)])
                s = s[once(s)]
                yield s, np.full(len(s), i)
                carry = s[-(SIZE - 1):]
        else:
            s = symbols("".join(f" {t} " for t in texts[i:j]))
            owner = np.repeat(np.arange(i, j), [len(t) + 2 for t in texts[i:j]])
            keep = once(s)
            keep[1:] |= owner[1:] != owner[:-1]
            yield s[keep], owner[keep]
        i = j


def bundles(texts: list[str], owners: np.ndarray, count: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of all texts of each owner, ``count`` rows of whole numbers, and its n-grams.  A text
    without letters has none."""
    out, size = np.zeros((count, dimensions)), np.zeros(count, np.int64)
    for s, text in _pieces(texts):
        used = np.zeros(_LAST + 1, bool)
        used[s] = True
        alphabet = np.flatnonzero(used)
        code = (np.cumsum(used) - 1)[s]
        n = len(s) - SIZE + 1
        if n <= 0:
            continue
        whole = np.flatnonzero(text[:n] == text[SIZE - 1:])
        gram = np.zeros(n, np.int64)
        for k in range(SIZE):
            gram = gram * len(alphabet) + code[k:n + k]
        gram, owner = gram[whole], owners[text[whole]]
        size += np.bincount(owner, minlength=count)
        if len(alphabet) ** SIZE <= 4 * PIECE:
            present = np.zeros(len(alphabet) ** SIZE, bool)
            present[gram] = True
            grams = np.flatnonzero(present)
            gram = (np.cumsum(present) - 1)[gram]
        else:
            grams, gram = np.unique(gram, return_inverse=True)
            gram = gram.reshape(-1)
        bits = sign_bits(alphabet, dimensions)
        turned = [np.packbits(np.roll(bits, SIZE - 1 - k, axis=1), axis=1) for k in range(SIZE)]
        low, used = np.unique(owner), np.zeros(count, np.int64)
        used[low] = np.arange(len(low))
        row = used[owner]
        many = len(grams) > 16 * GRAMS         # then sorting costs less than a look at all of them for each slice
        if many:
            order = np.argsort(gram, kind="stable")
            gram, row = gram[order], row[order]
        for at in range(0, len(grams), GRAMS):
            some = grams[at:at + GRAMS]
            a, b = np.searchsorted(gram, [at, at + len(some)]) if many else (0, len(gram))
            here = slice(a, b) if many or len(grams) <= GRAMS else (gram >= at) & (gram < at + len(some))
            bound = np.zeros((len(some), dimensions // 8), np.uint8)
            rest = some
            for k in range(SIZE - 1, -1, -1):
                bound ^= turned[k][rest % len(alphabet)]
                rest = rest // len(alphabet)
            counts = np.bincount(row[here] * len(some) + gram[here] - at, minlength=len(low) * len(some)).reshape(len(low), len(some)).astype(np.float32)
            product = counts @ np.unpackbits(bound, axis=1).astype(np.float32)
            out[low] += counts.sum(axis=1, dtype=np.float64)[:, None] - 2.0 * product
    return out, size


def _decoded(texts: list[bytes | None]) -> list[str]:
    return [(t or b"").decode() for t in texts]


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows ``(lang, chunk, v0, v1, ...)``: each language's bundle, ``WIDTH`` values a row, a table in
    the shared folder.  ``docs`` are the training documents; a null language is passed over."""
    values = [f"v{k}" for k in range(WIDTH)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, v in held.items():
                table = np.rint(v).astype(np.int64).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table), pa.string()), pa.array(np.arange(len(table)), pa.int32()),
                                                  *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(WIDTH))], names=["lang", "chunk", *values])
            held.clear()

        for batch, texts in X.blocks(batches, 1):
            lang = batch.column(0).dictionary_encode()
            own, _ = bundles(_decoded(texts), lang.indices.to_numpy().astype(np.int64), len(lang.dictionary), dimensions)
            for name, v in zip(lang.dictionary.to_pylist(), own):
                held[name] = held[name] + v if name in held else v
            if len(held) > HELD_LANGUAGES:
                yield from flush()
        yield from flush()

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("chunk", T.IntegerType()), *(T.StructField(v, T.LongType()) for v in values)])
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    summed = map_arrow(known, add, schema).groupBy("lang", "chunk").agg(*(F.sum(v).alias(v) for v in values))
    return written(summed, "language-prototypes")


def _unit_rows(rows: DataFrame, dimensions: int) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes of length one, of a bounded group of rows."""
    table = rows.toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    place = {x: k for k, x in enumerate(langs)}
    out = np.zeros((len(langs), dimensions // WIDTH, WIDTH))
    at = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    for k in range(WIDTH):
        out[at, table["chunk"].to_numpy(), k] = table[f"v{k}"].to_numpy()
    out = out.reshape(len(langs), dimensions)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def predict(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS,
            group_languages: int = GROUP_LANGUAGES) -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score)`` of every document; ``learned`` is a result of
    :func:`prototypes`."""
    spark = docs.sparkSession
    groups = -(-learned.where("chunk = 0").count() // group_languages)
    best = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *best])
    with_text = T.StructType([*schema.fields, T.StructField("text", T.StringType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                       F.col(text_col).cast("string").alias("text"))

    def step(shared, last: bool):
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, unit = shared.value
            for batch, texts in X.blocks(batches, 4):
                own, letters = bundles(_decoded(texts), np.arange(len(texts)), len(texts), dimensions)
                size = np.linalg.norm(own, axis=1)
                cosine = np.round(own @ unit.T / np.maximum(size, 1e-300)[:, None], 9)
                pred, score = batch.column(2).to_pylist(), batch.column(3).to_numpy().copy()
                for k, top in enumerate(np.argmax(cosine, axis=1).tolist()):      # the first of equals is the smallest language
                    c = max(0.0, min(1.0, float(cosine[k, top])))
                    if letters[k] and (pred[k] == UNKNOWN and not score[k] or c > score[k] or c == score[k] and langs[top] < pred[k]):
                        pred[k], score[k] = langs[top], c
                out = [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(out if last else [*out, batch.column(4)], names=schema.names if last else with_text.names)
        return compare

    for k in range(groups):
        shared = spark.sparkContext.broadcast(_unit_rows(learned.where(F.pmod(F.xxhash64("lang"), F.lit(groups)) == k), dimensions))
        if not shared.value[0]:                # no language fell into this group
            continue
        last = k == groups - 1
        rows = map_arrow(rows, step(shared, last), schema if last else with_text)
        if not last:
            rows = written(rows, "language-best")
            shared.unpersist()
    return rows.select(*schema.names)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes from the documents that are not held out, predictions for all."""
    learned = prototypes(docs.where(~held_out(id_col)), text_col, lang_col, dimensions)
    return predict(docs, learned, id_col, text_col, dimensions)
