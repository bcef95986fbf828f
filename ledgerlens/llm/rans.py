"""Static range asymmetric numeral system over token ids, in interleaved blocks (numpy).

A segment holds whole documents: their ids, back to back, are cut into blocks of
``LANES * steps`` tokens, and token ``t`` of a block belongs to lane ``t % LANES``.  All
blocks of a segment are coded side by side, one array operation for a step of every lane.
States lie in [2**31, 2**63) and move 32 bits at a time.  Every ``CHECK_STEPS`` steps a
block's states and its place in the word stream are stored: each stretch between two
checkpoints decodes on its own, so a segment decodes with all stretches in parallel.  Each
block's words, and the whole segment, carry a CRC-32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 32
BLOCK_STEPS = 2048
CHECK_STEPS = 512
SCALE_BITS = 20
LOW = np.uint64(1 << 31)

MAGIC = b"LLRS"
VERSION = 1
# size, part, first, documents, tokens, bytes of names, blocks, steps, checkpoints a block, words, crc of the model
_HEADER = struct.Struct("<4sI11q")
_U32, _U64 = np.uint64(32), np.uint64(0xFFFFFFFF)


class Model:
    """Frequencies that sum to ``2**SCALE_BITS``, at least 1 for each token that occurs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbol = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "Model":
        """Scale counts down; what rounding leaves over goes to or comes from the largest."""
        total, room = int(counts.sum()), 1 << SCALE_BITS
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        if (counts > 0).sum() > room // 2:
            raise ValueError("too many distinct tokens for the scale")
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(object) * room // total).astype(np.int64)), 0)
        rest = room - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        if rest > 0:
            freq[order[0]] += rest
        for k in order:                        # those that were raised to 1 are paid for by the large ones
            if rest >= 0:
                break
            cut = min(-rest, int(freq[k]) // 2)
            freq[k] -= cut
            rest += cut
        return cls(freq)

    @property
    def symbol(self) -> np.ndarray:
        """The token of each slot."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def to_bytes(self) -> bytes:
        body = self.freq.astype("<u4").tobytes()
        return struct.pack("<4sIq", MAGIC, VERSION, len(self.freq)) + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> "Model":
        magic, version, n = struct.unpack_from("<4sIq", data)
        body = data[16:16 + 4 * n]
        if magic != MAGIC or version != VERSION or struct.unpack_from("<I", data, 16 + 4 * n)[0] != zlib.crc32(body):
            raise ValueError("not a token model, or a damaged one")
        return cls(np.frombuffer(body, "<u4").astype(np.int64))


def encode(model: Model, ids: np.ndarray, names: list[bytes | None], lengths: np.ndarray, part: int, first: int) -> bytes:
    """One segment: documents ``names`` with ``lengths`` ids each, back to back in ``ids``."""
    n = len(ids)
    steps = min(BLOCK_STEPS, max(1, -(-n // LANES)))
    blocks = -(-n // (LANES * steps))
    checks = -(-steps // CHECK_STEPS)
    tokens = np.full(blocks * LANES * steps, int(np.argmax(model.freq)), np.int64)
    tokens[:n] = ids
    tokens = tokens.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    states = np.zeros((blocks, checks, LANES), np.uint64)
    out = np.zeros((blocks, steps, LANES), np.uint32)
    sent = np.zeros((blocks, steps, LANES), bool)
    for s in range(steps - 1, -1, -1):
        t = tokens[:, s]
        f = model.freq[t]
        full = state >= f << np.uint64(63 - SCALE_BITS)
        out[:, s], sent[:, s] = state & _U64, full
        state = np.where(full, state >> _U32, state)
        q = state // f
        state = (q << np.uint64(SCALE_BITS)) + (state - q * f) + model.first[t]
        if s % CHECK_STEPS == 0:
            states[:, s // CHECK_STEPS] = state
    per_step = sent.sum(axis=2)
    before = np.cumsum(per_step, axis=1) - per_step
    offsets = before[:, ::CHECK_STEPS].astype("<i8")
    sizes = per_step.sum(axis=1)
    words = [out[b][sent[b]].astype("<u4") for b in range(blocks)]
    name_bytes = b"".join(x or b"" for x in names)
    name_sizes = np.array([-1 if x is None else len(x) for x in names], "<i4")
    table = np.array([[k, zlib.crc32(w)] for k, w in zip(sizes, words)], "<i8").reshape(-1, 2)
    body = b"".join([name_sizes.tobytes(), name_bytes, lengths.astype("<i8").tobytes(), table.tobytes(), offsets.tobytes(),
                     states.astype("<u8").tobytes(), *(w.tobytes() for w in words)])
    head = _HEADER.pack(MAGIC, VERSION, _HEADER.size + len(body) + 4, part, first, len(names), n, len(name_bytes), blocks, steps,
                        checks, int(sizes.sum()), model.crc)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def split(data: memoryview, end: bytes = b"\n"):
    """The segments of a file, each followed by ``end``."""
    at = 0
    while at < len(data):
        size = _HEADER.unpack_from(data, at)[2]
        if data[at + size:at + size + len(end)] != end:
            raise ValueError("a segment does not end where it says")
        yield data[at:at + size]
        at += size + len(end)


def decode(model: Model, data: memoryview) -> tuple[int, int, list[bytes | None], np.ndarray, np.ndarray]:
    """``part, first, names, lengths, ids`` of one segment."""
    magic, version, size, part, first, n_docs, n, n_name, blocks, steps, checks, n_words, crc = _HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or len(data) != size or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a segment, or a damaged one")
    if crc != model.crc:
        raise ValueError("a segment of another model")
    at = _HEADER.size

    def take(kind: str, *shape: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
        at += got.nbytes
        return got

    name_sizes = take("<i4", n_docs)
    ends = np.cumsum(np.maximum(name_sizes, 0))
    raw = bytes(data[at:at + n_name])
    at += n_name
    names = [None if k < 0 else raw[e - k:e] for k, e in zip(name_sizes.tolist(), ends.tolist())]
    lengths, table = take("<i8", n_docs), take("<i8", blocks, 2)
    offsets, states = take("<i8", blocks, checks), take("<u8", blocks, checks, LANES)
    words = take("<u4", n_words)
    base = np.cumsum(table[:, 0]) - table[:, 0]
    for b in range(blocks):
        if zlib.crc32(words[base[b]:base[b] + table[b, 0]]) != table[b, 1]:
            raise ValueError(f"block {b} is damaged")
    # every stretch from a checkpoint to the next is a row of lanes of its own
    state = states.reshape(blocks * checks, LANES).copy()
    place = (base[:, None] + offsets).reshape(-1)
    length = min(steps, CHECK_STEPS)
    out = np.zeros((blocks * checks, length, LANES), np.uint32)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    for s in range(length):
        slot = (state & np.uint64((1 << SCALE_BITS) - 1)).astype(np.int64)
        t = model.symbol[slot]
        out[:, s] = t
        state = model.freq[t] * (state >> np.uint64(SCALE_BITS)) + slot.astype(np.uint64) - model.first[t]
        low = state < LOW
        index = np.minimum(place[:, None] + np.cumsum(low, axis=1) - 1, len(words) - 1)
        state = np.where(low, state << _U32 | words[index], state)
        place = place + low.sum(axis=1)
    tokens = out.reshape(blocks, checks * length, LANES)[:, :steps].reshape(-1) if blocks else np.zeros(0, np.uint32)
    return part, first, names, lengths, tokens[:n]
