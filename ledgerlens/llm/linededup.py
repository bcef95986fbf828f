"""Line dedup over overlapping three-line windows.

Every ``WIDTH`` consecutive lines of a text are one window, known by two 64-bit hashes.
Spark finds the first occurrence of each window that occurs more than once (documents by
id, then by position), by an aggregate that combines before it shuffles, and joins the
repeated ones back; that join is one whose hot keys Spark can split.  Every later
occurrence is removed: the lines its window covers go, overlapping and neighbouring windows
merge into runs, and the rest of the text is put together again.

Lines end at ``\\n`` and are compared exactly; a window of blank lines alone never counts.
Edge cases: a null text stays null and an empty one has one blank line; texts of fewer than
three lines have no window; a document that loses all lines keeps its row with an empty
text; documents with one id and different texts go by a hash of the text; repeated rows
(equal id and text) are one document: they do not remove each other and all lose the same
lines; a null id comes first; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc, text_hash, pos, k1, k2)``, one for each window; ``pos`` counts lines from 0."""
    lines = docs.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(quoted(text_col)).alias("text_hash"),
                        _lines(F.col(quoted(text_col))).alias("lines"))
    each = lines.select("doc", "text_hash", "lines", F.posexplode("lines").alias("pos", "line"))
    part = [F.col("line"), *(F.get("lines", F.col("pos") + k) for k in range(1, WIDTH))]
    return (each.where(F.col("pos") + WIDTH <= F.size("lines")).where(F.concat(*part).rlike(r"[^\x20\x09-\x0D]"))
            .select("doc", "text_hash", "pos", F.xxhash64(F.lit(1), *part).alias("k1"), F.xxhash64(F.lit(2), *part).alias("k2")))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``(doc, text_hash, at)``: sorted positions of windows that occurred before."""
    all_windows = windows(docs, id_col, text_col)
    place = F.struct("doc", "text_hash", "pos")
    first = (all_windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    later = all_windows.join(first, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = False) -> DataFrame:
    """``docs`` with the lines of later windows removed from the text column.  ``with_counts``
    returns ``doc_id, text, n_lines, n_removed, n_spans`` instead of the other columns."""
    later = later_windows(docs, id_col, text_col)
    own = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))
    text, doc = F.col("row").getField(text_col), F.col("row").getField(id_col)
    joined = own.join(later, doc.eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    # Runs of removed lines: a window starts one unless the window before it reaches it, and ends one likewise.
    at = F.col("at")
    starts = F.filter(at, lambda p, i: (i == 0) | (p > F.get(at, i - 1) + WIDTH))
    ends = F.transform(F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > p + WIDTH)), lambda p: p + WIDTH)
    runs = joined.select("row", _lines(text).alias("lines"), starts.alias("starts"), ends.alias("ends"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("starts")), lambda k: F.slice(
        "lines", F.coalesce(F.get("ends", k - 1), F.lit(0)) + 1,
        F.coalesce(F.get("starts", k), F.size("lines")) - F.coalesce(F.get("ends", k - 1), F.lit(0)))))
    new_text = F.when(F.col("starts").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join(kept, "\n"))
    if not with_counts:
        return runs.select(*[(new_text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
    total = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return runs.select(F.col("row").getField(id_col).alias("doc_id"), new_text.alias("text"),
                       F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                       (total(F.col("ends")) - total(F.col("starts"))).alias("n_removed"),
                       F.when(F.col("starts").isNull(), 0).otherwise(F.size("starts")).cast("long").alias("n_spans"))
