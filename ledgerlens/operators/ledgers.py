"""Two ledgers reconciled into the status vocabulary of the daily files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.aggs import quoted
from ..session import scratch_path
from .ordering import numbered

HOT_ROWS = 1_000_000             # an id with more rows on one side is numbered by ranges


def occurrences(df: DataFrame, key: str, order_by: Sequence[str], *, hot_rows: int = HOT_ROWS, out: str = "occurrence") -> DataFrame:
    """``df`` with each row's number, from 1, among the rows of its key in the order of ``order_by``.

    A window numbers the rows of a key in one task.  Keys with more than ``hot_rows`` rows, of which there are
    few, are numbered by their position in a table sorted by ranges, over many tasks.
    """
    k = quoted(key)
    window = Window.partitionBy(k).orderBy(*map(quoted, order_by))
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"hot-ids-{uuid.uuid4().hex}")
    hot = df.groupBy(k.alias("_hot")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select("_hot")
    hot.write.parquet(path)          # counted once: several joins read it
    hot = spark.read.schema(hot.schema).parquet(path)
    if hot.isEmpty():
        return df.withColumn(out, F.row_number().over(window))
    few = df.join(hot, k == F.col("_hot"), "left_anti").withColumn(out, F.row_number().over(window))
    many = numbered(df.join(hot, k == F.col("_hot"), "left_semi"), [key, *order_by], "_position")
    first = many.groupBy(k.alias("_hot")).agg(F.min("_position").alias("_first"))
    many = many.join(first, k == F.col("_hot")).withColumn(out, (F.col("_position") - F.col("_first") + 1).cast("int"))
    return few.unionByName(many.drop("_position", "_hot", "_first"))


def reconcile_ledgers(insurer: DataFrame, platform: DataFrame, *, key: str = "order_id", amount: str = "amount",
                      order_by: Sequence[str] = ("amount",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, occurrence, insurer_amount, platform_amount, amount_diff, reconcile_status)``.

    The n-th row of an id in one ledger meets the n-th in the other, in the order of ``order_by``; each row is
    used once.  Rows on both sides are ``match``, the others ``not_found_in_m`` (insurer only) or
    ``not_found_in_external`` (platform only).  A row without an id meets nothing.

    The join is on id and number, so the rows of a hot id are dealt out; rows without an id stay out of it.
    """
    sides = []
    for name, df in (("insurer_amount", insurer), ("platform_amount", platform)):
        rows = df.select(quoted(key).alias(key), *[quoted(c).alias(f"_o{n}") for n, c in enumerate(order_by)], quoted(amount).alias(name))
        sides.append((name, rows.where(quoted(key).isNotNull()), rows.where(quoted(key).isNull())))
    order = [f"_o{n}" for n in range(len(order_by))]
    left, right = (occurrences(known, key, order, hot_rows=hot_rows).withColumn(f"_{name}", F.lit(True)).select(key, "occurrence", name, f"_{name}")
                   for name, known, _ in sides)
    both = left.join(right, [key, "occurrence"], "full_outer")
    parts = [both]
    for name, _, unknown in sides:
        other = "platform_amount" if name == "insurer_amount" else "insurer_amount"
        parts.append(unknown.select(key, F.lit(None).cast("int").alias("occurrence"), name, F.lit(True).alias(f"_{name}"),
                                    F.lit(None).cast(both.schema[other].dataType).alias(other), F.lit(None).cast("boolean").alias(f"_{other}")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    status = (F.when(F.col("_insurer_amount") & F.col("_platform_amount"), S.STATUS_MATCH)
              .when(F.col("_insurer_amount"), S.STATUS_ONLY_M).otherwise(S.STATUS_ONLY_EXTERNAL))
    return rows.select(key, "occurrence", "insurer_amount", "platform_amount",
                       (F.col("insurer_amount") - F.col("platform_amount")).alias("amount_diff"), status.alias("reconcile_status"))
