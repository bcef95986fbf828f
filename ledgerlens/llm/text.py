"""Numpy helpers over batches of UTF-8 texts: word spans, word hashes and word-window hashes.

Every helper works on one contiguous byte buffer that holds many texts, each followed by
one space, so that a task handles millions of words with a few array operations.  Hashing
goes through the buffer in pieces that end between words: working memory is bounded by
the piece, not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
HASH_BYTES = 1 << 18              # of words hashed at a time: tables and sums of this size stay in the cache

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(is_word) -> np.ndarray:
    """Byte -> lower-cased word byte, or 0 where ``is_word`` is false; only A-Z fold."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return np.where(np.array([is_word(b) for b in range(256)]), low, 0).astype(np.uint8)


def _alnum(b: int) -> bool:
    return 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: on UTF-8 bytes the
#: class is digits, letters and every byte of a character beyond ASCII.
ALNUM_WORD = np.array([_alnum(b) for b in range(256)])
#: Words ``[^\x20\x09-\x0D]+``.
SPACED_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Byte folding A-Z to a-z.
FOLD = _table(lambda b: True)

_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLDED_CODES = _BYTE_CODES[FOLD]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _powers[k] = p
    return _powers[0], _powers[1]


class Texts:
    """Texts of one block: ``buf`` (each text, then a space), byte starts and ends."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
        self.ends = self.starts + sizes

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, in order; no word crosses texts."""
        m = np.zeros(len(self.buf) + 2, np.int8)
        m[1:-1] = is_word[self.buf]
        d = np.diff(m)
        return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

    def owner(self, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: index of its first word and of the word after its last."""
        return np.searchsorted(word_starts, self.starts), np.searchsorted(word_starts, self.ends)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if ``fold``."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
        at, stop = int(starts[i]), int(ends[j - 1])
        piece = buf[at:stop]
        up, down = _power_tables(stop - at + 1)
        codes = (_FOLDED_CODES if fold else _BYTE_CODES)[piece]
        codes *= up[:stop - at]
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def argsort(h: np.ndarray) -> np.ndarray:
    """What sorts 64-bit hashes: a sort of their high bits with the places in the low ones, which is much faster, unless
    different hashes agree in the high bits."""
    low = len(h).bit_length()
    joined = h >> np.uint64(low) << np.uint64(low) | np.arange(len(h), dtype=np.uint64)
    joined.sort()
    order = (joined & np.uint64((1 << low) - 1)).astype(np.int64)
    at = h[order]
    return order if (at[1:] >= at[:-1]).all() else np.argsort(h, kind="stable")


def hash_windows(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hashes of every ``width`` consecutive word hashes, by doubling: a window of 13 is
    put together from windows of 8, 4 and 1."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    base = (_BASE * (2 * seed + 1)) & _MASK | 1
    n = len(h) - width + 1
    out, done, part, size = np.zeros(n, np.uint64), 0, mix64(h ^ np.uint64(seed)), 1
    while True:
        if width & size:
            out = out * np.uint64(pow(base, size, 1 << 64)) + part[done:done + n]
            done += size
        if done == width:
            return mix64(out)
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


def blocks(batches: Iterator[pa.RecordBatch], text: int, block_bytes: int = BLOCK_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut record batches into slices of about ``block_bytes`` of text (one row at least);
    yields each slice with the UTF-8 bytes of its text column."""
    for batch in batches:
        col = batch.column(text)
        values = col.cast(pa.large_string() if pa.types.is_null(col.type) else col.type)
        values = values.cast(pa.large_string()).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]) \
            if len(values) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(values):
            j = max(i + 1, int(np.searchsorted(total, total[i] + block_bytes, side="right")) - 1)
            yield batch.slice(i, j - i), values.slice(i, j - i).to_pylist()
            i = j


def joined(batches: Iterator[pa.RecordBatch], text: int, block_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """:func:`blocks` over smaller batches: those of about ``block_bytes`` of text are put together first.  A batch's text
    column is taken to be most of it."""
    held, size = [], 0

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*(b.columns for b in held))], names=held[0].schema.names)

    for batch in batches:
        if held and size + batch.nbytes > block_bytes:
            yield from blocks(iter([one()]), text, block_bytes)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from blocks(iter([one()]), text, block_bytes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[k] .. starts[k] + lengths[k] - 1`` of all k, one after another."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return np.repeat(starts - (total - lengths), lengths) + np.arange(n, dtype=np.int64)
