"""Modified Kneser-Ney models of token 3-grams, one for each language, that score the texts they count.

Texts are rows ``(key, lang, text)`` with 64-bit keys; equal keys are copies of one text.  A token is a
word with A-Z lower-cased, or a single character of ``SINGLES``; texts begin with two start marks.  Counts
are those of Kneser-Ney: occurrences of 3-grams, distinct left neighbours below.  An n-gram that only one
text holds counts as unseen in scoring, so no text vouches for itself.

1. Spark counts the tokens.  The most frequent ones, at most ``VOCABULARY``, get codes by rank (a bounded
   broadcast); the others are rare and keep their 64-bit hashes.  Blocks of texts are written once as
   compressed arrays of codes, so that later passes do not read texts.
2. *Count.*  Every block deals its 3-grams to partitions by their middle token, as sorted, delta-coded
   arrays.  A partition then has all that its middle tokens need: 3-grams, their contexts (the first two
   tokens), their suffixes (the last two) with the suffixes' left neighbours, and the middle token as a
   context.  It merges the arrays to one sorted array and sends on counts of counts by language,
   distinct left neighbours by token, and the rare tokens it met.
3. Spark adds these up: discounts, probabilities of single tokens.
4. *Score.*  The same exchange again, now with discounts and token probabilities: each partition is a model
   in sorted arrays for its own 3-grams, and adds up log probabilities by text.  Sums are whole
   numbers of ``1 / FIXED``, so their order does not matter.

Both exchanges run in ``ROUNDS`` rounds, each for a part of the middle tokens, so only that part is on disk at
a time.  Left neighbours meet their tokens as sorted arrays, by range of hashes.  A middle token that has more than a partition's share of all tokens is split by the first
token; counts of its suffixes, which the split takes apart, are added up by Spark between the steps.
Tables are deleted after their last reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .shared import kept_table, map_arrow, remove, returning

ORDER = 3
VOCABULARY = 1 << 19
ROUNDS = 4
HOT = 1                          # a token is hot with more than this over the number of partitions
FIXED = 1 << 22
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20            # of a block that is cut into tokens at a time
BATCH_BYTES = (BLOCK_BYTES - (BLOCK_BYTES >> 6)) // 4     # of a batch that Spark hands to a step, of which it holds several copies: four make a block
HELD_TOKENS = 1 << 20            # distinct tokens that a counting task holds

#: Code points that are tokens by themselves: signs of Latin-1, scripts without spaces, general
#: punctuation, CJK, compatibility forms, pictographs.
SINGLES = [(0x80, 0xBF), (0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2000, 0x2BFF), (0x2E80, 0xA4CF),
           (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF), (0x20000, 0x3FFFF)]

_SINGLE_EDGES = np.array([x for a, b in SINGLES for x in (a, b + 1)])
_START = np.uint64(0xA5A5A5A5A5A5A5A5)
_DEAL = np.uint64(0x27D4EB2F165667C5)

_ENTRIES, _DISCOUNTS, _TOKEN, _SUFFIX = range(4)          # kinds of rows that a scoring partition reads
_STATS, _FOLLOWERS, _RARE, _HOT = range(4)                # kinds of rows that a counting partition sends
_COUNTED = ("kind int, p int, h1 long, h2 long, lang long, v0 long, v1 long, v2 long, v3 long, v4 long, blob binary")
_DEALT = "p int, kind int, block long, h1 long, h2 long, w0 double, w1 double, w2 double, w3 double, w4 double, w5 double, blob binary"


# --------------------------------------------------------------------------- arrays as bytes
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as bytes: by place of the byte, compressed; zero places cost nothing."""
    head, out = [len(arrays)], []
    for x in arrays:
        head += [x.dtype.itemsize, len(x)]
        places = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
        for place in places:
            part = pa.compress(place.tobytes(), codec="zstd", asbytes=True) if place.any() else b""
            head.append(len(part))
            out.append(part)
    return np.array([len(head), *head], np.uint32).tobytes() + b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    head, at, out, k = np.frombuffer(blob, np.uint32, n, 4).tolist(), 4 * (n + 1), [], 1
    for _ in range(head[0]):
        size, count = head[k:k + 2]
        places = np.zeros((size, count), np.uint8)
        for place, length in enumerate(head[k + 2:k + 2 + size]):
            if length:
                places[place] = np.frombuffer(pa.decompress(blob[at:at + length], count, codec="zstd", asbytes=True), np.uint8)
                at += length
        out.append(np.ascontiguousarray(places.T).reshape(-1).view(f"<u{size}"))
        k += 2 + size
    return out


def _u32(x) -> np.ndarray:
    return np.ascontiguousarray(x).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _unsigned(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted keys begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _order(*keys: np.ndarray) -> np.ndarray:
    """What sorts by whole numbers from 0 on, the first of them foremost: one sort of one number where they fit, with
    the places in its low bits if these fit too."""
    bits, low = [int(k.max()).bit_length() if len(k) else 0 for k in keys], len(keys[0]).bit_length()
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    joined = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits):
        joined <<= b
        joined |= k
    if sum(bits) + low > 63:
        return np.argsort(joined)
    joined <<= low
    joined |= np.arange(len(joined))
    joined.sort()
    return joined & ((1 << low) - 1)


def _dense(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, below ``size``, in order, and the number of each value among them."""
    seen = np.zeros(size, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[x]


def _ranges(h: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Parts of sorted hashes: a number, start and end of each part that holds any.  A part is a range of hashes."""
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    edges = np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])
    return ((k, int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges)).tolist())


# --------------------------------------------------------------------------- tokens
def token_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all tokens of a block, in order."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = X.SPACED_WORD[buf]
    wide = np.flatnonzero(buf >= 0xC0)
    b = [buf[np.minimum(wide + k, len(buf) - 1)].astype(np.int64) for k in range(4)]
    tail = [x & 63 for x in b]
    size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    point = np.where(size == 2, (b[0] & 31) << 6 | tail[1],
                     np.where(size == 3, (b[0] & 15) << 12 | tail[1] << 6 | tail[2], (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
    single = np.searchsorted(_SINGLE_EDGES, point, side="right") % 2 == 1
    first, size = wide[single], size[single]
    word[1 + X.ragged(first, size)] = 0
    word = word != 0
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(first):
        return starts, ends
    starts, ends = np.concatenate([starts, first]), np.concatenate([ends, first + size])
    order = np.argsort(starts, kind="stable")       # merges two runs
    return starts[order], ends[order]


def _hashes(texts: list[bytes | None], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the number of each text's, and the start mark of each text."""
    root = X.mix64(langs.astype(np.int64).view(np.uint64))
    upto = np.cumsum([0, *(len(t or b"") for t in texts)])
    found, counts, i = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PIECE_BYTES, side="right")) - 1)
        block = X.Texts(texts[i:j])
        s, e = token_spans(block.buf)
        first, last = block.owner(s)
        found.append(X.mix64(X.hash_words(block.buf, s, e) + np.repeat(root[i:j], last - first)))
        counts.append(last - first)
        i = j
    return np.concatenate(found), np.concatenate(counts), X.mix64(root ^ _START)


def _short(keys: np.ndarray) -> np.ndarray:
    """24 bits of a text's key: enough to tell the texts of one n-gram apart."""
    return (X.mix64(_unsigned(keys)) >> np.uint64(40)).astype(np.uint32)


class _Tally:
    """Tokens with their language, occurrences and least and greatest text, in order of hash."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def merge(self) -> tuple[np.ndarray, ...]:
        whole = lambda k: np.concatenate([p[k] for p in self.parts])
        h = whole(0)
        order = X.argsort(h)
        h = h[order]
        at = _starts(h)
        take = lambda x: x[at]
        sums = [f.reduceat if len(at) else lambda x, _: x for f in (np.add, np.minimum, np.maximum)]
        merged = (take(h), take(whole(1)[order]), *(f(whole(k)[order], at) for k, f in enumerate(sums, 2)))
        self.parts, self.rows = [merged], len(at)
        return merged


def token_counts(plain: DataFrame) -> DataFrame:
    """Rows ``(h, lang, n, shared)``: occurrences of every token, and whether two texts hold it; start marks
    count as tokens here."""
    parts = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(tally: _Tally) -> Iterator[pa.RecordBatch]:
        h, lang, n, low, high = tally.merge()
        langs, lang = np.unique(lang, return_inverse=True)
        out = [(p, pack(np.diff(h[a:b], prepend=np.uint64(0)), _u32(lang.reshape(-1)[a:b]), _unsigned(langs), _u32(n[a:b]), _u32(low[a:b]), _u32((high - low)[a:b])))
               for p, a, b in _ranges(h, parts)]
        tally.__init__()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["p", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch, texts in X.joined(batches, 2, BLOCK_BYTES):
            langs = batch.column(1).to_numpy()
            h, n, start = _hashes(texts, langs)
            each = np.arange(len(texts), dtype=np.int32)
            h, owner = np.concatenate([h, start]), np.concatenate([np.repeat(each, n), each])
            order = X.argsort(h)
            h, owner = h[order], owner[order]
            key, at = _short(batch.column(0).to_numpy())[owner], _starts(h)
            if len(at):
                tally.add(h[at], langs[owner[at]], np.diff(np.append(at, len(h))), np.minimum.reduceat(key, at), np.maximum.reduceat(key, at))
            del batch, texts, langs, h, n, start, owner, order, key, at
            if tally.rows > HELD_TOKENS and len(tally.merge()[0]) > HELD_TOKENS // 2:
                yield from send(tally)
        if tally.rows:
            yield from send(tally)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                h, lang, langs, n, low, more = unpack(blob)
                tally.add(np.cumsum(h), langs.view(np.int64)[lang], n.astype(np.int64), low, low + more)
                if tally.rows > HELD_TOKENS and tally.rows > 2 * len(tally.parts[0][0]):
                    tally.merge()
        if tally.rows:
            h, lang, n, low, high = tally.merge()
            for i in range(0, len(h), 1 << 16):
                j = i + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[i:j])), pa.array(lang[i:j]), pa.array(n[i:j]), pa.array(low[i:j] != high[i:j])],
                                                 names=["h", "lang", "n", "shared"])

    sent = map_arrow(plain.select("key", "lang", "text"), returning(count), "p int, blob binary")
    return map_arrow(sent.repartitionById(parts, "p"), returning(add), "h long, lang long, n long, shared boolean")


class Vocabulary:
    """Codes of the frequent tokens, by rank; hot tokens and their splits."""

    def __init__(self, h: np.ndarray, lang: np.ndarray, n: np.ndarray, hot: np.ndarray, splits: np.ndarray):
        order = np.lexsort((h, -n))
        self.hash, self.lang, self.size, self.least = h[order].view(np.uint64), lang[order], len(h), int(n.min()) if len(n) else 1 << 62
        self.code = np.argsort(self.hash)
        self.sorted = self.hash[self.code]
        by = np.argsort(hot.view(np.uint64))
        self.hot, self.splits = hot.view(np.uint64)[by], splits[by].astype(np.uint64)

    def __getstate__(self) -> dict:
        """What a broadcast holds: half as many bytes."""
        langs, lang = np.unique(self.lang, return_inverse=True)
        return self.__dict__ | {"sorted": None, "code": self.code.astype(np.int32), "lang": (langs, _u32(lang.reshape(-1)))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.code, self.lang = self.code.astype(np.int64), self.lang[0][self.lang[1]]
        self.sorted = self.hash[self.code]

    def codes(self, h: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of tokens, and hashes, in order, and languages of the rare ones, which are numbered from ``size`` on."""
        order = X.argsort(h)
        h, out = h[order], np.empty(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), max(self.size - 1, 0))
        known = self.sorted[at] == h if self.size else np.zeros(len(h), bool)
        out[order[known]] = self.code[at[known]]
        rare, place = h[~known], order[~known]
        first = _starts(rare)
        out[place] = self.size + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rare))))
        return out, rare[first], langs[place[first]]

    def split(self, middle: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The split of each 3-gram by the hashes of its middle and first token: 0 unless it is hot."""
        if not len(self.hot):
            return np.zeros(len(middle), np.uint64)
        at = np.minimum(np.searchsorted(self.hot, middle), len(self.hot) - 1)
        return np.where(self.hot[at] == middle, X.mix64(before) % self.splits[at], np.uint64(0))

    def is_hot(self, middle: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(middle), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, middle), len(self.hot) - 1)] == middle


def _slot(middle: np.ndarray, split: np.ndarray) -> np.ndarray:
    return X.mix64(X.mix64(middle ^ _DEAL) + split)


def vocabulary(tokens: DataFrame, parts: int, most: int) -> Vocabulary:
    """As many whole powers of two of the count as ``most`` tokens hold, and the tokens that are hot for ``parts`` partitions,
    at most as many as these over ``HOT``."""
    power = F.floor(F.log2("n"))
    rows = {r["power"]: (r["rows"], r["all"]) for r in tokens.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).collect()}
    held, least = 0, None
    for k in sorted(rows, reverse=True):
        held += rows[k][0]
        if held > most:
            break
        least = k
    top = tokens.where(F.lit(False) if least is None else power >= least).select("h", "lang", "n").toArrow()
    total = sum(n for _, n in rows.values())
    hot = tokens.where(F.col("n") * parts > HOT * total).select("h", "n").toArrow()
    n = hot["n"].to_numpy()
    return Vocabulary(top["h"].to_numpy().copy(), top["lang"].to_numpy(), top["n"].to_numpy(), hot["h"].to_numpy().copy(), -(-n * parts // max(HOT * total, 1)))


# --------------------------------------------------------------------------- blocks of codes
def _grams(codes: np.ndarray, n: np.ndarray, start: np.ndarray, lang: np.ndarray, here: np.ndarray) -> list[np.ndarray]:
    """First, middle and last token of the 3-grams that end in the tokens ``here``, and their texts; each text begins
    after two start marks of its language."""
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)[here]
    place = here - (np.cumsum(n, dtype=np.int64) - n)[owner]
    mark = start[lang][owner]
    return [*(np.where(place >= k, codes[here - k], mark) for k in (2, 1)), codes[here], owner]


def coded_blocks(plain: DataFrame, shared, rounds: int) -> DataFrame:
    """Rows ``(block, blob)``: the codes of a block's texts, the round of the 3-gram that ends in each, their keys
    and languages."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = shared.value, TaskContext.get().partitionId() << 32
        for batch, texts in X.joined(batches, 2, BLOCK_BYTES):
            langs = batch.column(1).to_numpy()
            h, n, start = _hashes(texts, langs)
            each, lang = np.unique(langs, return_inverse=True)
            first, lang = np.unique(langs, return_index=True)[1], lang.reshape(-1)
            codes, rare, rare_lang = words.codes(np.concatenate([h, start[first]]), np.concatenate([np.repeat(lang.astype(np.int32), n), np.arange(len(each), dtype=np.int32)]))
            a, b, _, _ = _grams(codes[:len(h)], n, codes[len(h):], lang, np.arange(len(h)))
            hash_of = np.concatenate([words.hash, rare])
            middle = hash_of[b]
            turn = (_slot(middle, words.split(middle, hash_of[a])) % np.uint64(rounds)).astype(np.uint8)
            blob = pack(_unsigned(batch.column(0).to_numpy()), _u32(lang), _unsigned(each), _u32(n), _u32(codes), np.diff(rare, prepend=np.uint64(0)), _u32(rare_lang), turn)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])
            number += 1

    return map_arrow(plain.select("key", "lang", "text"), returning(code), "block long, blob binary")


def _deal(blob: bytes, words: Vocabulary, turn: int, rounds: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """The 3-grams of a block whose turn it is: a partition and its arrays, one after another."""
    keys, lang, langs, n, codes, rare, rare_lang, turns = unpack(blob)
    here = np.flatnonzero(turns == turn)
    if not len(here):
        return
    rare, codes = np.cumsum(rare), codes.view(np.int32)
    a, b, c, owner = _grams(codes[:len(turns)], n, codes[len(turns):], lang, here)
    hash_of = np.concatenate([words.hash, rare])
    middle = hash_of[b]
    part = (_slot(middle, words.split(middle, hash_of[a])) // np.uint64(rounds) % np.uint64(parts)).astype(np.int64)
    order = _order(part, _dense(b, len(hash_of))[1], c)
    a, b, c, owner, part = a[order], b[order], c[order], owner[order], part[order]
    short = _short(keys.view(np.int64))
    edges = np.append(_starts(part), len(part))
    for low, high in zip(edges[:-1], edges[1:]):
        one = [x[low:high] for x in (a, b, c)]
        is_rare = [x >= words.size for x in one]
        strange = np.sort(np.concatenate([x[r] for x, r in zip(one, is_rare)]))
        strange = strange[_starts(strange)]
        for x, r in zip(one, is_rare):
            x[r] = words.size + np.searchsorted(strange, x[r])
        docs, doc = _dense(owner[low:high], len(n))
        own, own_lang = np.unique(rare_lang[strange - words.size], return_inverse=True)
        new = np.diff(one[1], prepend=-1) != 0
        step = np.where(new, one[2], np.diff(one[2], prepend=0))
        yield int(part[low]), pack(_u32(np.diff(one[1], prepend=0)), _u32(step), _u32(one[0]), _u32(doc), _u32(np.diff(docs, prepend=0)),
                                   short[docs], np.diff(rare[strange - words.size], prepend=np.uint64(0)), _u32(own_lang.reshape(-1)), langs[own])


class Merged:
    """The 3-grams of one partition, in order of middle, last and first token."""

    def __init__(self, blobs: list[bytes], words: Vocabulary):
        parts = [unpack(b) for b in blobs]
        for part in parts:
            part[6] = np.cumsum(part[6])
        join = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint32)
        rare, first = np.unique(join(6).astype(np.uint64), return_index=True)
        self.hash = np.concatenate([words.hash, rare])
        rare_lang = np.concatenate([p[8][p[7]] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.lang = np.concatenate([words.lang, rare_lang.view(np.int64)[first]])
        self.size, self.documents = words.size, [np.cumsum(p[4].astype(np.int64)) for p in parts]
        a, b, c, key, slot, offset = [], [], [], [], [], 0
        for k, p in enumerate(parts):
            middle = np.cumsum(p[0].view(np.int32), dtype=np.int32)
            new = np.diff(middle, prepend=-1) != 0
            step = p[1].view(np.int32)
            total = np.cumsum(step, dtype=np.int64)
            last = (total - np.repeat((total - step)[new], np.diff(np.append(np.flatnonzero(new), len(new))))).astype(np.int32)
            own = (words.size + np.searchsorted(rare, p[6])).astype(np.int32)
            for out, x in ((a, p[2].astype(np.int32)), (b, middle), (c, last)):
                strange = x >= words.size
                x[strange] = own[x[strange] - words.size]
                out.append(x)
            key.append(p[5][p[3]])
            slot.append(p[3].astype(np.int32) + np.int32(offset))
            offset += len(p[4])
            parts[k] = None
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        a, b, c, key, slot = whole(a, np.int32), whole(b, np.int32), whole(c, np.int32), whole(key, np.uint32), whole(slot, np.int32)
        order = _order(b, c, a)
        a, pair = a[order].astype(np.int64), b[order].astype(np.int64) << 32 | c[order]
        key, self.slot = key[order].astype(np.int64), slot[order]
        del b, c, slot, order
        at = _starts(pair, a)                                     # 3-grams
        self.count = np.diff(np.append(at, len(a)))
        low, high = (f.reduceat(key, at) if len(at) else key for f in (np.minimum, np.maximum))
        self.shared, self.first, pair = low != high, a[at], pair[at]
        self.gram = np.repeat(np.arange(len(at)), self.count)     # of each entry
        to = _starts(pair)                                        # suffixes
        self.before = np.diff(np.append(to, len(at)))
        self.low, self.high = (f.reduceat(x, to) if len(to) else x for f, x in ((np.minimum, low), (np.maximum, high)))
        self.middle, self.last = pair[to] >> 32, pair[to] & 0xFFFFFFFF
        self.suffix = np.repeat(np.arange(len(to)), self.before)  # of each 3-gram
        self.hot = words.is_hot(self.hash[self.middle])


def _counts_of_counts(values: np.ndarray, lang: np.ndarray) -> Iterator[list[int]]:
    """``lang``, all, and how many values are 1, 2, 3, 4."""
    langs, which = np.unique(lang, return_inverse=True)
    table = np.bincount(which.reshape(-1) * 5 + np.where(values <= 4, values, 0), minlength=5 * len(langs)).reshape(-1, 5)
    for x, row in zip(langs.tolist(), table.tolist()):
        yield [x, sum(row), *row[1:]]


def _count(shared, follow_parts: int):
    """The reduce step of counting; see ``_COUNTED``."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, p = [], 0
        for batch in batches:
            blobs += batch.column(1).to_pylist()
            p = batch.column(0)[0].as_py() if batch.num_rows else p
        if not blobs:
            return
        m = Merged(blobs, shared.value)
        del blobs
        lang = m.lang[m.middle]
        stats = [[size, *row] for size, values, langs in ((3, m.count, lang[m.suffix]), (2, m.before[~m.hot], lang[~m.hot]))
                 for row in _counts_of_counts(values, langs)]
        size, of, *counts = np.array(stats, np.int64).reshape(-1, 7).T
        yield from _counted(len(size), kind=_STATS, p=p, h1=size, lang=of, **{f"v{k}": x for k, x in enumerate(counts)})
        token, n = np.unique(m.last[~m.hot], return_counts=True)
        order = np.argsort(m.hash[token])
        sent = list(_neighbours(shared.value, m.hash[token][order], n[order], follow_parts))
        yield from _counted(len(sent), kind=_FOLLOWERS, p=[k for k, _ in sent], blob=[b for _, b in sent])
        rare = _signed(m.hash[np.unique(m.last[m.last >= m.size])])
        yield from _counted(len(rare), kind=_RARE, p=p, h1=rare)
        hot = np.flatnonzero(m.hot)
        yield from _counted(len(hot), kind=_HOT, h1=_signed(m.hash[m.middle[hot]]), h2=_signed(m.hash[m.last[hot]]), lang=lang[hot],
                            v0=m.before[hot], v1=m.low[hot], v2=m.high[hot])

    return step


def _counted(rows: int, **columns) -> Iterator[pa.RecordBatch]:
    """Batches of ``_COUNTED``; a column is an array or one value, and null if left out."""
    names, kinds = zip(*(x.split() for x in _COUNTED.split(", ")))
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    arrays = []
    for name, kind in zip(names, types):
        x = columns.get(name)
        arrays.append(pa.nulls(rows, kind) if x is None else pa.repeat(pa.scalar(x, kind), rows) if isinstance(x, int) else pa.array(x, kind))
    for i in range(0, rows, 1 << 16):
        yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in arrays], names=names)


def _neighbours(words: Vocabulary, h: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Numbers of left neighbours by sorted hash, cut into ranges of hashes: frequent tokens by their place among all
    frequent ones, rare ones by their hash."""
    for k, a, b in _ranges(h, parts):
        at = np.searchsorted(words.sorted, h[a:b])
        known = words.sorted[np.minimum(at, words.size - 1)] == h[a:b] if words.size else np.zeros(b - a, bool)
        yield k, pack(_u32(np.diff(at[known], prepend=0)), _u32(n[a:b][known]), np.diff(h[a:b][~known], prepend=np.uint64(0)), _u32(n[a:b][~known]))


def _sent_neighbours(shared, parts: int):
    """Rows ``(h, a)`` as arrays of :func:`_neighbours`."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = _summed(_unsigned(batch.column(0).to_numpy()), batch.column(1).to_numpy())
            yield _sent(0, list(_neighbours(shared.value, h, n, parts)))

    return step


def _sent_tokens(parts: int):
    """Rows of :func:`token_counts` as arrays, cut into ranges of hashes."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lang, n, shared = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            order = np.argsort(_unsigned(h))
            h, n, shared = _unsigned(h)[order], _unsigned(n)[order], shared.astype(np.uint8)[order]
            langs, lang = np.unique(lang[order], return_inverse=True)
            lang = lang.reshape(-1)
            yield _sent(1, [(k, pack(np.diff(h[a:b], prepend=np.uint64(0)), _u32(lang[a:b]), _unsigned(langs), n[a:b], shared[a:b])) for k, a, b in _ranges(h, parts)])

    return step


def _sent(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())],
                                      names=["p", "kind", "blob"])


def _with_neighbours(shared):
    """Rows ``(h, lang, n, shared, a)`` of the tokens of a range that have left neighbours: ``a`` distinct ones."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tokens, held = shared.value, [], [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind:
                    h, lang, langs, n, both = unpack(blob)
                    tokens.append((np.cumsum(h), langs.view(np.int64)[lang], n.view(np.int64), both.astype(bool)))
                    continue
                at, n, h, more = unpack(blob)
                held.append((np.concatenate([words.sorted[np.cumsum(at, dtype=np.int64)], np.cumsum(h)]), np.concatenate([n, more]).astype(np.int64)))
                if sum(len(x) for x, _ in held) > max(1 << 20, 2 * len(held[0][0])):
                    held = [_summed(*map(np.concatenate, zip(*held)))]
        h, a = _summed(*map(np.concatenate, zip(*held)))
        if not len(h) or not tokens:
            return
        own, *columns = map(np.concatenate, zip(*tokens))
        order = np.argsort(own)
        at = np.minimum(np.searchsorted(own[order], h), len(own) - 1)
        met = own[order][at] == h
        columns = [_signed(h[met]), *(x[order][at][met] for x in columns), a[met]]
        for i in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)]) for x in columns], names=["h", "lang", "n", "shared", "a"])

    return step


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    at = _starts(h[order])
    return h[order][at], np.add.reduceat(n[order], at) if len(at) else n


# --------------------------------------------------------------------------- discounts
def _discounts(stats: DataFrame) -> DataFrame:
    """Rows ``(lang, size, types, total, d1, d2, d3, rest)`` from counts of counts by language and order; ``rest`` is the weight
    of backing off from the empty context, of order 1 alone."""
    n = [F.col(f"n{k}").cast("double") for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2])
    some = (n[1] > 0) & (n[2] > 0)
    d = [F.when(some & (n[k] > 0), F.least(F.greatest(k - (k + 1) * y * n[k + 1] / F.nullif(n[k], F.lit(0.0)), F.lit(0.1)), F.lit(k - 0.05)))
         .otherwise(F.lit(0.5)).alias(f"d{k}") for k in (1, 2, 3)]
    summed = stats.groupBy("lang", "size").agg(F.sum("total").alias("total"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(5)))
    out = summed.select("lang", "size", F.col("n0").alias("types"), "total", "n1", "n2", *d)
    cut = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * (F.col("types") - F.col("n1") - F.col("n2"))
    return out.withColumn("rest", F.try_divide(cut, F.col("total"))).drop("n1", "n2")


def _discount(a: str) -> Column:
    return F.when(F.col(a) == 1, F.col("d1")).when(F.col(a) == 2, F.col("d2")).otherwise(F.col("d3"))


def _sizes(a: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n0"), *(F.count(F.when(F.col(a) == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))]


class _Model:
    """The values that a scoring partition needs beside its 3-grams."""

    def __init__(self, m: Merged, top: tuple[np.ndarray, np.ndarray], aux: dict[int, list[np.ndarray]]):
        chance, log = (np.concatenate([x, np.zeros(len(m.hash) - m.size)]) for x in top)
        lang = m.lang[m.middle]
        of, _, size, *d = aux[_DISCOUNTS]
        langs = np.unique(of)
        unseen = np.zeros(len(langs))
        unseen[np.searchsorted(langs, of[size == 1])] = d[3][size == 1]
        log[m.size:] = unseen[np.searchsorted(langs, m.lang[m.size:])]       # rare tokens of one text alone
        h, _, *w = aux[_TOKEN]
        at = m.size + np.searchsorted(m.hash[m.size:], _unsigned(h))
        chance[at], log[at] = w[0], w[1]
        table = np.zeros((4, len(langs), 4))                     # by order, language, count
        table[size.astype(np.int64), np.searchsorted(langs, of), 1:] = np.stack(d[:3], axis=1)
        which = np.searchsorted(langs, lang)

        before, shared = m.before.copy(), m.low != m.high
        total = np.bincount(m.middle, before, len(m.hash))
        cut = np.bincount(m.middle, table[2, which, np.minimum(before, 3)], len(m.hash))
        rest = (cut / np.maximum(total, 1))[m.middle]
        total = total[m.middle]
        if m.hot.any():
            # Suffixes of hot tokens come whole from the other splits.
            middle, last, a, both, of_total, of_rest = aux[_SUFFIX][:6]
            key = X.mix64(_unsigned(middle)) + _unsigned(last)
            order, hot = np.argsort(key), np.flatnonzero(m.hot)
            at = order[np.searchsorted(key[order], X.mix64(m.hash[m.middle[hot]]) + m.hash[m.last[hot]])]
            before[hot], shared[hot], total[hot], rest[hot] = a[at], both[at] > 0, of_total[at], of_rest[at]
        own = (before - table[2, which, np.minimum(before, 3)]) / total
        self.single = log[m.last]
        suffix_chance = own + rest * chance[m.last]
        self.suffix_shared = shared
        with np.errstate(divide="ignore"):
            self.suffix_log = suffix_log = np.where(shared, np.log(np.where(shared, suffix_chance, 1.0)), np.log(rest) + self.single)
        context = m.middle[m.suffix] << 32 | m.first
        _, which_context = np.unique(context, return_inverse=True)
        which_context, which = which_context.reshape(-1), which[m.suffix]
        taken = table[3, which, np.minimum(m.count, 3)]
        total = np.bincount(which_context, m.count)[which_context] if len(context) else np.zeros(0)
        rest = np.bincount(which_context, taken)[which_context] / total if len(context) else np.zeros(0)
        chance = (m.count - taken) / total + rest * suffix_chance[m.suffix]
        self.log = np.where(m.shared, np.log(np.where(m.shared, chance, 1.0)), np.log(rest) + suffix_log[m.suffix])


def _arrays(m: Merged, model: _Model) -> Iterator[tuple[int, int, bytes]]:
    """Order, number and bytes of a partition's 3-grams and suffixes that two texts hold: sorted hashes and log
    probabilities, in ``1 / FIXED``."""
    h = m.hash
    suffix = X.mix64(h[m.middle]) + h[m.last]
    for size, key, log, shared in ((3, X.mix64(X.mix64(h[m.first]) + suffix[m.suffix]), model.log, m.shared), (2, suffix, model.suffix_log, model.suffix_shared)):
        at = np.flatnonzero(shared)
        at = at[np.argsort(key[at])]
        yield size, len(at), pack(np.diff(key[at], prepend=np.uint64(0)), _u32(np.rint(np.maximum(-log[at], 0.0) * FIXED)))


def _score(shared, top, arrays: bool = False):
    """The reduce step of scoring: rows ``(block, blob)`` with sums by text of a block; with ``arrays``
    the model instead, rows ``(size, entries, blob)``."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, blocks = [], []
        aux: dict[int, list] = {_DISCOUNTS: [], _TOKEN: [], _SUFFIX: []}
        for batch in batches:
            kind = batch.column(1).to_numpy()
            entries = batch.filter(pa.array(kind == _ENTRIES))
            blobs += entries.column(11).to_pylist()
            blocks += entries.column(2).to_pylist()
            for k in aux:
                some = batch.filter(pa.array(kind == k))
                aux[k].append([some.column(3).to_numpy(False), some.column(4).fill_null(0).to_numpy(False),
                               *(some.column(c).fill_null(0.0).to_numpy(False) for c in range(5, 10))])
        if not blobs:
            return
        aux = {k: [np.concatenate(x) for x in zip(*v)] for k, v in aux.items()}
        m = Merged(blobs, shared.value)
        model = _Model(m, top.value, aux)
        if arrays:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*_arrays(m, model)), (pa.int32(), pa.int64(), pa.binary()))],
                                             names=["size", "entries", "blob"])
            return
        whole = np.rint(np.maximum(-model.log, 0.0) * FIXED)[m.gram]
        single = np.rint(np.maximum(-model.single, 0.0) * FIXED)[m.suffix][m.gram]
        size = sum(map(len, m.documents))
        sums = [np.bincount(m.slot, x, size).astype(np.uint64) for x in (whole, single)]
        edges = np.cumsum([0, *map(len, m.documents)])
        out = [pack(_u32(np.diff(docs, prepend=0)), *(x[a:b] for x in sums)) for docs, a, b in zip(m.documents, edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["block", "blob"])

    return step


def _by_block(final: bool):
    """Sums of each block's texts, from rows ``(block, kind, blob)`` in order of block; ``final`` adds keys and tokens
    from the codes (kind 1)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, size, head = None, [], 0, None

        def add(docs, *values):
            nonlocal size
            size = max(size, int(docs[-1]) + 1 if len(docs) else 0)
            for k, x in enumerate(values):
                if len(sums[k]) < size:
                    sums[k] = np.concatenate([sums[k], np.zeros(max(size - len(sums[k]), len(sums[k])), np.uint64)])
                sums[k][docs] += x

        def out():
            if now is None:
                return
            if not final:
                docs = np.flatnonzero(sums[0][:size])
                blob = pack(_u32(np.diff(docs, prepend=0)), *(x[docs] for x in sums))
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])
            elif head is not None and len(head[0]):
                keys, n = head
                whole = [np.concatenate([x, np.zeros(max(0, len(keys) - len(x)), np.uint64)])[:len(keys)].astype(np.int64) for x in sums]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), *map(pa.array, whole)],
                                                 names=["key", "tokens", "whole", "single"])

        for batch in batches:
            for block, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if block != now:
                    yield from out()
                    now, sums, size, head = block, [np.zeros(0, np.uint64)] * 2, 0, None
                if kind:
                    parts = unpack(blob)
                    head = parts[0].copy(), parts[1].copy()
                else:
                    docs, *values = unpack(blob)
                    add(np.cumsum(docs.astype(np.int64)), *values)
        yield from out()

    return step


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and numbers of tokens of each block."""
    for batch in batches:
        blobs = []
        for blob in batch.column(1).to_pylist():
            parts = unpack(blob)
            blobs.append(pack(parts[0], parts[3]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["block", "blob"])


def log_scores(plain: DataFrame, vocabulary_size: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """Rows ``(key, tokens, whole, single)`` of ``plain`` (``key, lang, text``), one for each key with a token: the number of
    tokens, and the negative log probabilities of all by the model and by single tokens, in ``1 / FIXED``."""
    return _run(plain, vocabulary_size, rounds, False)


def model(plain: DataFrame, vocabulary_size: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """The model as rows ``(size, entries, blob)``: sorted arrays (see :func:`unpack`) of the hashes and log probabilities
    of the n-grams that two texts hold, a row for each order, partition and round."""
    return _run(plain, vocabulary_size, rounds, True)


def _run(plain: DataFrame, vocabulary_size: int, rounds: int, arrays: bool) -> DataFrame:
    spark: SparkSession = plain.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens, tokens_at = kept_table(token_counts(plain), "quality-tokens", batch_bytes=BATCH_BYTES)
    words = vocabulary(tokens, parts, vocabulary_size)
    shared = spark.sparkContext.broadcast(words)
    codes, codes_at = kept_table(coded_blocks(plain, shared, rounds), "quality-codes", batch_bytes=BATCH_BYTES)

    def dealt(turn: int) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows = list(_deal(blob, shared.value, turn, rounds, parts))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                                                          pa.array([b for _, b in rows], pa.binary())], names=["p", "block", "blob"])
        return map_arrow(codes, deal, "p int, block long, blob binary")

    follow_parts = max(1, parts // 4)
    counted, counted_at = [], []
    for turn in range(rounds):
        table, at = kept_table(map_arrow(dealt(turn).select("p", "blob").repartitionById(parts, "p"), returning(_count(shared, follow_parts)), _COUNTED), "quality-counted",
                               batch_bytes=BATCH_BYTES)
        counted.append(table)
        counted_at.append(at)
    every = counted[0]
    for table in counted[1:]:
        every = every.union(table)

    # Suffixes of hot tokens, whole; left neighbours and values of single tokens; discounts.
    suffixes, suffixes_at = kept_table(
        every.where(F.col("kind") == _HOT).groupBy("h1", "h2", "lang").agg(F.sum("v0").alias("a"), (F.min("v1") != F.max("v2")).alias("shared")), "quality-hot")
    sent = (map_arrow(tokens.select("h", "lang", "n", "shared"), _sent_tokens(follow_parts), "p int, kind int, blob binary")
            .union(every.where(F.col("kind") == _FOLLOWERS).select("p", F.lit(0).alias("kind"), "blob"))
            .union(map_arrow(suffixes.groupBy("h2").agg(F.count(F.lit(1)).alias("a")), _sent_neighbours(shared, follow_parts), "p int, kind int, blob binary")))
    single, single_at = kept_table(map_arrow(sent.repartitionById(follow_parts, "p"), _with_neighbours(shared), "h long, lang long, n long, shared boolean, a long"),
                                   "quality-single")
    remove(spark, tokens_at)
    zero = F.lit(0).cast("long").alias("total")
    stats = (every.where(F.col("kind") == _STATS).select("lang", F.col("h1").cast("int").alias("size"), zero, *(F.col(f"v{k}").alias(f"n{k}") for k in range(5)))
             .union(suffixes.groupBy("lang").agg(F.lit(2).alias("size"), zero, *_sizes("a")))
             .union(single.groupBy("lang").agg(F.lit(1).alias("size"), F.sum("a").alias("total"), *_sizes("a"))))
    discounts, discounts_at = kept_table(_discounts(stats), "quality-discounts")
    one = discounts.where("size = 1").withColumnRenamed("lang", "of_lang")
    chance = (F.col("a") - _discount("a")) / F.col("total") + F.col("rest") / F.col("types")
    values = (single.join(one, F.col("lang") == F.col("of_lang")).withColumn("chance", chance)
              .select("h", "n", "shared", "chance", F.when(F.col("shared"), F.log("chance")).otherwise(F.log(F.col("rest") / F.col("types"))).alias("log")))
    top = _top_values(values, words)
    top = spark.sparkContext.broadcast(top)

    two = discounts.where("size = 2").withColumnRenamed("lang", "of_lang")
    contexts = suffixes.groupBy(F.col("h1").alias("of_h1"), F.col("lang").alias("of")).agg(
        F.sum("a").alias("w2"), *(F.count(F.when(F.least("a", F.lit(3)) == k, 1)).alias(f"m{k}") for k in (1, 2, 3)))
    contexts = contexts.join(two, F.col("of") == F.col("of_lang")).select(
        "of_h1", F.col("w2").cast("double").alias("w2"), ((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("w2")).alias("w3"))
    places = [(int(h.view(np.int64)), int(s % np.uint64(rounds)), int(s // np.uint64(rounds) % np.uint64(parts)))
              for h, k in zip(words.hot, words.splits) for s in np.unique(_slot(np.full(int(k), h), np.arange(int(k), dtype=np.uint64)))]
    places = spark.createDataFrame(sorted(set(places)), "at_h1 long, turn int, p int")

    def long(df: DataFrame, **columns: Column) -> DataFrame:
        fields = [x.split() for x in _DEALT.split(", ")]
        return df.select(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))

    # What partitions need of languages and rare tokens, of all rounds.
    met = None
    for turn, table in enumerate(counted):
        table = table.where(F.col("kind").isin(_STATS, _RARE)).select(F.lit(turn).alias("turn"), "kind", "p", "h1", F.col("lang").alias("met_lang"))
        met = table if met is None else met.union(table)
    langs = met.where(F.col("kind") == _STATS).select("turn", "p", "met_lang").distinct().join(discounts, F.col("met_lang") == F.col("lang"))
    rare = met.where(F.col("kind") == _RARE).join(values.where((F.col("n") < words.least) & F.col("shared")), F.col("h1") == F.col("h"))
    given, given_at = kept_table(
        langs.select("turn", F.lit(_DISCOUNTS).alias("kind"), "p", F.col("lang").alias("h1"), F.col("size").cast("double").alias("w0"), F.col("d1").alias("w1"),
                     F.col("d2").alias("w2"), F.col("d3").alias("w3"), F.log(F.col("rest") / F.col("types")).alias("w4"))
        .unionByName(rare.select("turn", F.lit(_TOKEN).alias("kind"), "p", "h1", F.col("chance").alias("w0"), F.col("log").alias("w1")), allowMissingColumns=True),
        "quality-given")
    for at in (single_at, *counted_at):
        remove(spark, at)

    scored, scored_at = [], []
    for turn in range(rounds):
        hot = (suffixes.join(places.where(F.col("turn") == turn), F.col("h1") == F.col("at_h1")).join(contexts, F.col("h1") == F.col("of_h1")))
        rows = (long(dealt(turn), kind=F.lit(_ENTRIES), p=F.col("p"), block=F.col("block"), blob=F.col("blob"))
                .union(long(given.where(F.col("turn") == turn), **{c: F.col(c) for c in ("kind", "p", "h1", "w0", "w1", "w2", "w3", "w4")}))
                .union(long(hot, kind=F.lit(_SUFFIX), p=F.col("p"), h1=F.col("h1"), h2=F.col("h2"), w0=F.col("a"), w1=F.col("shared").cast("int"), w2=F.col("w2"), w3=F.col("w3"))))
        if arrays:
            table, at = kept_table(map_arrow(rows.repartitionById(parts, "p"), _score(shared, top, True), "size int, entries long, blob binary"), "quality-model", batch_bytes=BATCH_BYTES)
            scored.append(table)
            continue
        sums = map_arrow(rows.repartitionById(parts, "p"), returning(_score(shared, top)), "block long, blob binary")
        dense = map_arrow(sums.select("block", F.lit(0).alias("kind"), "blob").repartition(parts, "block").sortWithinPartitions("block"), _by_block(False),
                          "block long, blob binary")
        table, at = kept_table(dense, "quality-sums", batch_bytes=BATCH_BYTES)
        scored.append(table.select("block", F.lit(0).alias("kind"), "blob"))
        scored_at.append(at)
    if arrays:
        out = scored[0]
        for table in scored[1:]:
            out = out.union(table)
        return out
    heads = map_arrow(codes, _heads, "block long, blob binary").select("block", F.lit(1).alias("kind"), "blob")
    for table in scored:
        heads = heads.union(table)
    by_text = map_arrow(heads.repartition(parts, "block").sortWithinPartitions("block"), _by_block(True), "key long, tokens long, whole long, single long")
    out, _ = kept_table(by_text.where("tokens > 0").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("tokens", "whole", "single"))), "quality-scores-by-text",
                        batch_bytes=BATCH_BYTES)
    for at in (codes_at, suffixes_at, given_at, discounts_at, *scored_at):
        remove(spark, at)
    shared.unpersist()
    top.unpersist()
    return out


def _top_values(values: DataFrame, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Probability and log probability of the frequent tokens, by code; start marks have none."""
    chance, log = np.zeros(words.size), np.zeros(words.size)
    wanted = values.where(F.col("n") >= words.least).select("h", "chance", "log").toArrow()
    at = words.code[np.searchsorted(words.sorted, _unsigned(wanted["h"].to_numpy()))] if words.size else np.zeros(0, np.int64)
    chance[at], log[at] = wanted["chance"].to_numpy(), wanted["log"].to_numpy()
    return chance, log
