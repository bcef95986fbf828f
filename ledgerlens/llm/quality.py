"""Quality rules: base counts of each text, then n-gram perplexity within language bands.

The model (:mod:`ledgerlens.llm.knlm`) is a modified Kneser-Ney model of token 3-grams, one for each
language, counted over all documents; it grows with the corpus.  An n-gram that no other text holds
counts as unseen, so no text vouches for itself: copies of a text are one text here.

By language, quartiles of all documents that pass the base rules.  A document is rejected whose log
perplexity lies more than ``spread`` interquartile ranges above the third quartile (text unlike the
language), or whose log perplexity by single tokens, the model's lowest order, lies that far below the
first (text that hardly varies).  The lower band is on single tokens because near copies of a text make
its longer n-grams likely: a lower band on these would reject every member of a family of near copies.
Short texts vary more, so the room beside the quartiles grows with the square root of
``REFERENCE_CHARS`` over a text's characters in words.

Every language has a model and bands of its own, however many there are; documents of a null
language share one.

Words of the base counts are ``[^\\x20\\x09-\\x0D]+``.  Edge cases: a null or empty text has
counts of zero and fails the base rules (fewer than 20 words); texts without a token have no
perplexity; repeated rows are judged row by row; a language without documents that pass has no
band; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import knlm
from . import text as X
from .knlm import SINGLES  # noqa: F401
from .shared import map_arrow, written

SPREAD = 2.5
REFERENCE_CHARS = 1000           # shorter texts get a wider band
BIN = 0.001                      # width of a log-perplexity bin
BROADCAST_GRAMS = knlm.VOCABULARY   # frequent tokens that tasks look up without a shuffle
BATCH_BYTES = 2 << 20            # of a batch of documents that a task counts
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
_NO_CHAR = np.array([b & 0xC0 == 0x80 for b in range(256)]) | (X.SPACED_WORD == 0)      # bytes that begin no character of a word


def _key(text_col: str, lang_col: str) -> Column:
    """A hash of language and text: copies have one key."""
    lang = F.col(lang_col).cast("string")
    return F.xxhash64(lang.isNull(), lang, F.col(text_col).cast("string"))


def _plain(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Rows ``(key, lang, text)``; ``lang`` is a hash, zero for null."""
    lang = F.col(lang_col).cast("string")
    return docs.select(_key(text_col, lang_col).alias("key"), F.when(lang.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(lang)).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))


def log_perplexities(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Rows ``(key, log_perplexity, log_single)``, one for each distinct language and text with a
    token; the last by single tokens alone."""
    mean = lambda x: F.round(F.col(x) / F.col("tokens") / knlm.FIXED, 9)
    found = knlm.log_scores(_plain(docs, text_col, lang_col), broadcast_grams)
    return found.select("key", mean("whole").alias("log_perplexity"), mean("single").alias("log_single"))


def base_counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    block = X.Texts(texts)
    s, e = block.words(X.SPACED_WORD)
    first, last = block.owner(s)

    def within(table: np.ndarray) -> np.ndarray:
        """Bytes of each text that the table marks."""
        at = np.flatnonzero(table[block.buf])
        return np.searchsorted(at, block.ends) - np.searchsorted(at, block.starts)

    h = X.hash_words(block.buf, s, e, fold=False)
    owner = np.repeat(np.arange(len(texts)), last - first)
    covered = np.zeros(len(s) + 1, np.int64)
    w = X.hash_windows(h, REPEAT_WINDOW)
    if len(w):
        at = np.flatnonzero(owner[:len(w)] == owner[REPEAT_WINDOW - 1:])
        key = w[at] ^ X.mix64(owner[at].astype(np.uint64) + np.uint64(1))
        order = X.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
        covered = np.bincount(again, minlength=len(covered)) - np.bincount(again + REPEAT_WINDOW, minlength=len(covered))
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    dup = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        lines = (t or b"").split(b"\n")
        if len(set(lines)) == len(lines):
            continue
        seen = set()
        for line in lines:
            if line in seen:
                dup[k] += bool(line.strip(b" \t\n\v\f\r"))
            else:
                seen.add(line)
    return {"n_words": last - first,
            "word_chars": block.ends - block.starts - within(_NO_CHAR),
            "n_symbols": within(_IS_SYMBOL),
            "n_dup_lines": dup, "n_repeat_words": repeated[last] - repeated[first]}


def _failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Per document ``key, lang``, its counts, ``base_failed``, ``log_perplexity`` and
    ``log_single`` (a table in the shared folder)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("key", T.LongType()), T.StructField("lang", T.StringType()),
                           *(T.StructField(n, T.LongType()) for n in _COUNTS), T.StructField("base_failed", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in X.blocks(batches, 3):
            base = base_counts(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(base[n], pa.int64()) for n in _COUNTS), pa.array(_failed(base))],
                                             names=schema.names)

    plain = docs.select(F.col(id_col), _key(text_col, lang_col).alias("key"), F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    found = log_perplexities(docs, text_col, lang_col, broadcast_grams)
    return written(map_arrow(plain, count, schema).join(found, "key", "left"), "quality-scores", batch_bytes=BATCH_BYTES)


def bands(scored: DataFrame, spread: float = SPREAD) -> DataFrame:
    """By language, quartiles of ``log_perplexity`` and of ``log_single`` and the room beside them,
    from all documents that pass the base rules: ``high, room, low_single, room_single``."""
    out = None
    for column, low, high, room in (("log_perplexity", "low", "high", "room"), ("log_single", "low_single", "high_single", "room_single")):
        bins = (scored.where(~F.col("base_failed") & F.col(column).isNotNull())
                .groupBy("lang", F.floor(F.col(column) / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
        w = Window.partitionBy("lang")
        at = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        place = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) * BIN
        own = (at.groupBy("lang").agg(place(0.25).alias(low), place(0.75).alias(high))
               .withColumn(room, spread * (F.col(high) - F.col(low) + BIN)).withColumnRenamed("lang", "band"))
        out = own if out is None else out.join(own.withColumnRenamed("band", "other"), F.col("band").eqNullSafe(F.col("other"))).drop("other")
    return written(out, "quality-bands")


def _judged(scored: DataFrame, spread: float) -> DataFrame:
    """``scored`` with ``kept``."""
    wider = F.sqrt(F.greatest(F.lit(1.0), REFERENCE_CHARS / F.greatest(F.col("word_chars"), F.lit(1))))
    inside = ((F.col("log_perplexity") <= F.col("high") + F.col("room") * wider)
              & (F.col("log_single") >= F.col("low_single") - F.col("room_single") * wider))
    both = scored.join(F.broadcast(bands(scored, spread)), F.col("lang").eqNullSafe(F.col("band")), "left")
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   spread: float = SPREAD, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Per document ``doc_id``, its counts, ``base_failed, kept`` and ``log_perplexity``."""
    judged = _judged(scores(docs, id_col, text_col, lang_col, broadcast_grams), spread)
    return judged.select("doc_id", *_COUNTS, "base_failed", "kept", "log_perplexity")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   spread: float = SPREAD, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are; a verdict depends on language and
    text alone, so rejected keys tell the rows that go."""
    judged = _judged(scores(docs, id_col, text_col, lang_col, broadcast_grams), spread)
    gone = written(judged.where(~F.col("kept")).select(F.col("key").alias("quality_key")).distinct(), "quality-gone")
    return docs.join(gone, _key(text_col, lang_col) == gone["quality_key"], "left_anti")
