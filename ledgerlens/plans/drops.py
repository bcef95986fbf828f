"""Write a table as a tree of daily CSV drops (for ingest tests and the bench).

Spark writes one CSV per day (``partitionBy("biz_date")`` after hashing the
rows by day, so each day lands in one task and one file); the files are then
moved to the contract layout ``<base>/YYYY/MM/DD/<prefix><YYYYMMDD>.csv``.
Days alternate between two header spellings and column orders, so a load
over the tree meets header drift.  The moves are renames of the Hadoop file
system that holds the folders (the shared scratch folder); no row goes through the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

# Header variants of the transaction file: (logical column, header) in file order.
TRANSACTION_HEADERS = [
    [("order_id", "ORDER_ID"), ("merchant", "MERCHANT"), ("amount", "TOTAL_AMOUNT"),
     ("order_time", "ORDER_TIME"), ("reconcile_status", "RECONCILE_STATUS"),
     ("insurance_status", "INSURANCE_STATUS"), ("is_business_order", "IS_BUSINESS_ORDER"),
     ("service_type", "SERVICE_TYPE"), ("gsm_amount", "GSM_AMOUNT"), ("merchant_amount", "MERCHANT_AMOUNT")],
    [("service_type", "SERVICE_TYPE"), ("reconcile_status", "Reconcile Status"), ("order_id", "ORDER_ID"),
     ("gsm_amount", "GSM Amount"), ("merchant_amount", "Merchant Amount"), ("amount", "AMOUNT"),
     ("merchant", "MERCHANT"), ("order_time", "ORDER_TIME"), ("is_business_order", "IS_BUSINESS_ORDER"),
     ("insurance_status", "INSURANCE_STATUS")],
]


def write_daily_drops(df: DataFrame, base: str, staging: str, *, dataset: str = "reconciled",
                      headers=TRANSACTION_HEADERS, suffix: str = "") -> int:
    """Write ``df`` (with ``biz_date``) as daily CSV files under ``base``, in place of those of the same
    name; ``suffix`` (``"_2"``) makes them re-issues.  Returns the file count."""
    variant = F.dayofmonth("biz_date") % len(headers)
    for i, cols in enumerate(headers):
        part = df.where(variant == i).select("biz_date", *[F.col(c).alias(h) for c, h in cols])
        (part.repartition("biz_date").write.mode("overwrite")
         .option("header", "true").option("quote", '"').option("escape", '"').option("nullValue", "")
         .option("timestampNTZFormat", S.ORDER_TIME_FORMAT).partitionBy("biz_date").csv(f"{staging}/v{i}"))
    return _move(df, f"{staging}/v*/biz_date=*/part-*.csv", base, dataset, suffix)


def write_line_drops(lines: DataFrame, base: str, staging: str, *, dataset: str = "reconciled") -> int:
    """Write ``lines`` (``biz_date, place, line``) as daily files of raw text, in the order of ``place``."""
    (lines.repartition("biz_date").sortWithinPartitions("biz_date", "place").select("biz_date", "line")
     .write.mode("overwrite").partitionBy("biz_date").text(f"{staging}/v0"))
    return _move(lines, f"{staging}/v*/biz_date=*/part-*.txt", base, dataset, "")


def _move(df: DataFrame, pattern: str, base: str, dataset: str, suffix: str) -> int:
    """Rename written files to the contract layout."""
    spark, prefix = df.sparkSession, S.FILE_PREFIXES[dataset]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    done: set[str] = set()
    for status in fs.globStatus(path(pattern)):
        part = status.getPath()
        day = part.getParent().getName().split("=", 1)[1]          # YYYY-MM-DD
        if day in done:       # hashing by day puts each day in one task, hence one file
            raise RuntimeError(f"more than one file for {day}")
        done.add(day)
        y, m, d = day.split("-")
        fs.mkdirs(path(f"{base}/{y}/{m}/{d}"))
        target = path(f"{base}/{y}/{m}/{d}/{prefix}{y}{m}{d}{suffix}.csv")
        fs.delete(target, False)
        fs.rename(part, target)
    return len(done)


def delete_files(spark: SparkSession, paths) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path(p).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(p), False)
