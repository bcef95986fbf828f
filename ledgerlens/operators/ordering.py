"""Positions in a total order, and pages by number at any depth (L3).

:func:`numbered` sorts a table by ranges, a partition each, and adds up the partitions' sizes: every row
gets its position without a window over the whole table, so a key that holds a third of all
rows is spread like any other (the order's further columns part its rows).

:func:`write_page_index` keeps every ``stride``-th key with its position.  A page of a size that the
stride divides is then the key range between two entries: :func:`page_at` reads that range alone, by a
filter that reaches the scan, whatever the page's number.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.aggs import quoted
from ..session import scratch_path
from .filters import priority_order

PART_BITS = 33                   # of monotonically_increasing_id: the row's place in its partition


def numbered(df: DataFrame, order_by: Sequence[str], out: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's position, from 0, in the order of ``order_by`` (nulls first; ties in any order).

    One shuffle by range; the sorted table is written to the shared scratch folder, so that positions
    stay as they are when an executor is lost.  Only a row for each partition is summed up in one place.
    """
    spark = df.sparkSession
    keys = [quoted(c) for c in order_by]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    path = scratch_path(spark, f"numbered-{uuid.uuid4().hex}")
    placed.write.parquet(path)
    rows = (spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_place", PART_BITS).cast("int"))
            .withColumn("_place", F.col("_place").bitwiseAND((1 << PART_BITS) - 1)))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("_part", "_rows"))).alias("_all")).select(
        F.posexplode("_all").alias("_k", "_one"), "_all")
    before = listed.select(F.col("_one._part").alias("_part"), F.aggregate(F.slice("_all", F.lit(1), F.col("_k")), F.lit(0).cast("long"),
                                                                           lambda a, x: a + x["_rows"]).alias("_before"))
    return rows.join(before, "_part").withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def write_page_index(df: DataFrame, path: str, *, order_by: Sequence[str] = ("order_id",), stride: int = 100) -> None:
    """L3: the keys at positions 0, ``stride``, 2 x ``stride``, ... and, without a key, the number of rows.

    ``order_by`` must tell all rows apart.  The index has a row for each ``stride`` rows and is read by range.
    """
    placed = numbered(df.select(*map(quoted, order_by)), order_by, "_position").select("_position", F.struct(*map(quoted, order_by)).alias("key"))
    entries = placed.where(F.col("_position") % stride == 0)
    total = placed.agg(F.count(F.lit(1)).alias("_position")).select("_position", F.lit(None).cast(placed.schema["key"].dataType).alias("key"))
    (entries.union(total).withColumnRenamed("_position", "position").repartitionByRange("position").sortWithinPartitions("position")
     .withColumn("stride", F.lit(stride)).write.mode("overwrite").parquet(path))


def _between(order_by: Sequence[str], low: Row, high: Row | None) -> Column:
    """Rows from the key ``low`` on and before ``high``.  Whole keys compare with nulls first; the first
    column alone is compared as well, as that reaches the scan."""
    key, lead = F.struct(*map(quoted, order_by)), quoted(order_by[0])
    literal = lambda row: F.struct(*[F.lit(v).alias(c) for c, v in zip(order_by, row)])
    out = key >= literal(low)
    if low[0] is not None:
        out = out & (lead >= F.lit(low[0]))
    if high is not None:
        near = lead.isNull() if high[0] is None else lead <= F.lit(high[0])
        out = out & (key < literal(high)) & (near if low[0] is not None or high[0] is None else lead.isNull() | near)
    return out


def page_at(df: DataFrame, index: DataFrame, page: int, size: int, *, order_by: Sequence[str] = ("order_id",)) -> DataFrame:
    """L3: page ``page`` (0-based) of ``size`` rows in the order of ``order_by``, by the index of
    :func:`write_page_index`; an empty table beyond the last page.

    Two index entries reach the driver.  The rows between them, at most the page and a stride, are
    sorted; if the stride divides the page they are the page, with nothing to skip.
    """
    found = index.select("stride").first()
    stride = found["stride"] if found else 1
    first, last = page * size, (page + 1) * size
    low_at, high_at = first // stride * stride, -(-last // stride) * stride
    entries = {r["position"]: r["key"] for r in index.where(F.col("position").isin(low_at, high_at)).collect()}
    low, high = entries.get(low_at), entries.get(high_at)
    if low is None:
        return priority_order(df.where(F.lit(False)))
    rows = df.where(_between(order_by, low, high))
    rows = rows.orderBy(*map(quoted, order_by))
    return priority_order((rows.offset(first - low_at) if first > low_at else rows).limit(size))
