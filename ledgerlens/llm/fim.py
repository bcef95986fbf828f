"""Fill-in-middle: every text is cut at two unit ranks and its parts change places.

A unit is a word with the white space before it, or the white space that ends a text:
``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``.  Cut ranks and form follow from a hash of
the document's id, so a run that is repeated cuts alike.

The places of the ranks come from an indexable skip list over a block's units
(:class:`SkipList`): every link carries the units and the code points that it skips, express
lanes skip many at once, and a descent by accumulated widths ends exactly at a rank.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>``
prefix ``<M>`` middle, ``plain`` is the text.  Texts are whole; there is one map step and no
shuffle.

Edge cases: a null or empty text is plain and empty, as is a text that holds one of the marks
plain; a null id is hashed as an empty one; repeated rows give the same output; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import map_arrow

SEED = 42
FIM_PERCENT = 50                 # of the documents get a form with marks
SPM_PERCENT = 80                 # of those are suffix first
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")

FAN = 8                          # one node in so many goes up a lane
_END = np.int64(1) << np.int64(60)
_IS_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


class SkipList:
    """Indexable skip lists of many texts side by side.

    A node stands before each unit and at the end of a text.  On lane 0 a node links to the
    next one; a lane above keeps every text's first node and about one in ``FAN`` of the
    others.  ``units[k]`` and ``points[k]`` are the widths of lane k's links (the last link of a
    text is wider than any rank), ``down[k]`` the same nodes on the lane below."""

    def __init__(self, first: np.ndarray, points: np.ndarray):
        """``first``: each text's first node; ``points``: code points from each node to the next."""
        units = np.ones(len(points), np.int64)
        units[np.append(first[1:], len(points))[:len(first)] - 1] = _END
        rank = np.arange(len(points)) - np.repeat(first, np.diff(np.append(first, len(points))))
        height = X.mix64(rank.astype(np.uint64) + np.uint64(1))
        self.units, self.points, self.down, self.first = [units], [points], [None], first
        at, above = first, 1
        while len(self.units[-1]) > len(first):
            up = (height % np.uint64(FAN ** above) == 0) | (rank == 0)
            kept = np.flatnonzero(up)
            self.units.append(np.add.reduceat(self.units[-1], kept))
            self.points.append(np.add.reduceat(self.points[-1], kept))
            self.down.append(kept)
            at, rank, height, above = np.searchsorted(kept, at), rank[kept], height[kept], above + 1
        self.top = at

    def find(self, ranks: np.ndarray) -> np.ndarray:
        """Code points before the unit of each text's rank."""
        at, left, points = self.top, ranks.astype(np.int64), np.zeros(len(ranks), np.int64)
        for lane in range(len(self.units) - 1, -1, -1):
            go = self.units[lane][at] <= left
            while go.any():
                left = left - np.where(go, self.units[lane][at], 0)
                points = points + np.where(go, self.points[lane][at], 0)
                at = at + go
                go = self.units[lane][at] <= left
            if lane:
                at = self.down[lane][at]
        return points


def unit_list(texts: list[bytes | None]) -> tuple[np.ndarray, SkipList | None]:
    """Units of each text, and their skip list."""
    if not texts:
        return np.zeros(0, np.int64), None
    block = X.Texts(texts)
    s, e = block.words(X.SPACED_WORD)
    first, last = block.owner(s)
    words = last - first
    stop = np.append(e, 0)[np.maximum(last, 1) - 1]               # end of the last word
    tail = np.where(words > 0, stop, block.starts) < block.ends
    n = words + tail
    head = np.cumsum(n + 1) - (n + 1)
    bounds = np.empty(int((n + 1).sum()), np.int64)
    bounds[head] = block.starts
    bounds[X.ragged(head + 1, words)] = e
    bounds[(head + n)[tail]] = block.ends[tail]
    lead = np.concatenate([[0], np.cumsum(_IS_LEAD[block.buf])])
    points = np.diff(np.append(lead[bounds], 0))
    points[head + n] = 0
    return n, SkipList(head, points)


def _hashes(id_col: str, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the id's sha256, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Rows ``(doc_id, n, form, prefix_chars, middle_chars, text)``, one for each document: its units,
    the code points of prefix and middle (null if plain) and the output."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("text", T.StringType())])
    marks = re.compile("|".join(map(re.escape, MARKS)).encode())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in X.blocks(batches, 1):
            h = [batch.column(2 + k).to_numpy() for k in range(4)]
            n, units = unit_list(texts)
            a, b = (units.find(f(h[0] % (n + 1), h[1] % (n + 1))) for f in (np.minimum, np.maximum))
            form = np.where(h[2] % 100 >= fim_percent, "plain", np.where(h[3] % 100 < spm_percent, "spm", "psm")).tolist()
            out = []
            for k, t in enumerate(texts):
                t = t or b""
                if not t or form[k] == "plain" or marks.search(t):
                    form[k] = "plain"
                    out.append(t.decode())
                    continue
                t = t.decode()
                prefix, middle, suffix = t[:a[k]], t[a[k]:b[k]], t[b[k]:]
                out.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form[k] == "psm"
                           else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64(), mask=plain),
                                              pa.array(b - a, pa.int64(), mask=plain), pa.array(out, pa.string())], names=schema.names)

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(_hashes(id_col, seed))))
    return map_arrow(plain, cut, schema)


def restored(text_col: str = "text", form_col: str = "form") -> Column:
    """The text before :func:`fill_in_middle`, from its output and form.  No part holds a mark, and
    none arises where a part meets one, so the marks part an output."""
    text = F.col(text_col)
    part = F.split(text, "|".join(f"\\Q{m}\\E" for m in MARKS))
    put = lambda *order: F.concat(*(F.get(part, F.lit(k)) for k in order))
    return F.when(F.col(form_col) == "psm", put(1, 3, 2)).when(F.col(form_col) == "spm", put(2, 3, 1)).otherwise(text)
