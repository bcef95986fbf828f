"""Token ids of whole texts with a public tokenizer file, by distinct chunk.

A BPE tokenizer splits a text into pretokens before it merges, so a text may be cut at
places where a pretoken always ends and the ids of the parts put together.  Each block of
texts is cut at such places (see ``_cuts``), its distinct chunks are found by Arrow's
dictionary encoding, and only chunks that the task has not met before go to the
tokenizer; a chunk that is one pretoken of Latin letters goes straight to its BPE model.
Texts with a possible special token or white space beyond ASCII are not cut.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .text import Texts, ragged

CACHE_CHUNKS = 500_000        # distinct chunks a task keeps; beyond that it starts anew

_ODD = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SOLID = np.array([33 <= b != 127 for b in range(256)])
_ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_PUNCT = np.array([33 <= b <= 126 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b != 39 for b in range(256)])


def _cuts(buf: np.ndarray) -> np.ndarray:
    """True where a chunk may start: before a single space or line break between two other
    characters, after such a line break, and between an ASCII letter or digit and ASCII
    punctuation other than the apostrophe."""
    solid, alnum, punct = _SOLID[buf], _ALNUM[buf], _PUNCT[buf]
    cut = np.zeros(len(buf), bool)
    between = solid[:-2] & solid[2:]
    line = between & (buf[1:-1] == 10)
    cut[1:-1] |= line | (between & (buf[1:-1] == 32))
    cut[2:] |= line
    cut[1:] |= (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])
    return cut


#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other
#: bytes, in order, for the characters from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(_LEVEL[32])
_LATIN_END = "\u0250"


class Encoder:
    """``encode`` gives the ids of many texts as one uint32 array and their counts."""

    def __init__(self, path: str, fold_case: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold_case = fold_case
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        new = [c for c in chunks if c not in self.known]
        if new:
            if len(self.known) > CACHE_CHUNKS:
                self.known, new = {}, chunks
            rest = [c for c in new if not self._letters(c)]
            coded = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in rest], add_special_tokens=False)
            self.known.update((c, array("I", x.ids).tobytes()) for c, x in zip(rest, coded))
        return [self.known[c] for c in chunks]

    def _letters(self, chunk: bytes) -> bool:
        """Encode a chunk that is Latin letters after at most one space; false for others."""
        spaced = chunk[0] == 32
        body = chunk[spaced:].decode("utf-8")
        if not body.isalpha() or not (body.isascii() or max(body) < _LATIN_END and "\u0130" not in body):
            return False
        if self.fold_case:                     # this file's tokenizer folds case and drops white space
            body, spaced = body.lower(), False
        level = body if body.isascii() else body.encode("utf-8").decode("latin-1").translate(_LEVEL)
        level = _SPACE + level if spaced else level
        self.known[chunk] = array("I", [x.id for x in self.model.tokenize(level)]).tobytes()
        return True

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        block = Texts(texts)
        buf, n = block.buf, len(block.buf)
        cut = _cuts(buf) if n > 2 else np.zeros(n, bool)
        joined = buf.tobytes()
        odd = _ODD.search(joined) is not None
        if self.fold_case and not odd and b"\xc4\xb0" not in joined:
            joined = joined.lower()            # bytes.lower folds A-Z alone; the tokenizer folds the rest
        if odd:
            for a, b in zip(block.starts, block.ends):
                if _ODD.search(joined, int(a), int(b)):
                    cut[a:b] = False
        full = block.ends > block.starts
        cut[block.starts[full]] = True
        cut[block.ends] = True                 # the space that ends each text is a chunk of its own, dropped below
        at = np.flatnonzero(cut)
        offsets = np.concatenate([at, [n]]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        keep = np.ones(len(at), bool)
        keep[np.searchsorted(at, block.ends)] = False
        coded = chunks.dictionary_encode()
        index = coded.indices.to_numpy()
        used = np.zeros(len(coded.dictionary), bool)
        used[index[keep]] = True
        parts = [b""] * len(used)
        words = coded.dictionary.take(pa.array(np.flatnonzero(used))).to_pylist()
        for k, ids in zip(np.flatnonzero(used), self._ids(words)):
            parts[k] = ids
        flat = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
        index = index[keep]
        lengths = sizes[index]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[index], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        first = np.searchsorted(at[keep], block.starts)
        last = np.searchsorted(at[keep], block.ends)
        return ids, total[last] - total[first]


@functools.lru_cache(maxsize=4)
def encoder(path: str, fold_case: bool = False) -> Encoder:
    """One encoder for each tokenizer file and worker process."""
    return Encoder(path, fold_case)


def public(name: str) -> str:
    """Place of a file of the installed public tokenizers, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
