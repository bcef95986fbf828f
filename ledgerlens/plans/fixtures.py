"""Reconciliation-shaped tables derived from the driver's Parquet data.

The reconciliation files themselves are produced upstream; to exercise every
operator at scale (and to compare with an independent SQL engine), the same
shape is derived from the TPC-H-like tables:

* ``recon``  - one row per order: the transaction file (insurer vs platform).
* ``driver`` - one row per line item: the driver-order file, with duplicated ids.
* ``file_catalog`` - a catalogue of day files (paths, versions, sizes).
* ``header_slices`` - ``driver`` rows written under three header spellings.

The derivation rules are fixed values of the test contract and must equal the
SQL in :mod:`ledgerlens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.tables import read_table

MONEY = S.MONEY


def _two(c):
    return F.lpad(c.cast("string"), 2, "0")


def _wall_clock_text(ts, add_seconds):
    """``yyyy-MM-dd HH:mm:ss`` of a TIMESTAMP_NTZ plus a number of seconds.

    Built from the date and the second of the day, so no session time zone is
    involved (formatting functions would convert to a zoned timestamp and move
    wall-clock times that fall into a daylight-saving gap).
    """
    total = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) + add_seconds
    day = F.date_add(ts.cast("date"), (total / 86400).cast("int"))
    rem = total % 86400
    return F.concat(day.cast("string"), F.lit(" "), _two((rem / 3600).cast("int")), F.lit(":"),
                    _two(((rem % 3600) / 60).cast("int")), F.lit(":"), _two(rem % 60))


def recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction table (one row per order that exists on at least one side).

    Plan shape: line items are pre-aggregated per order (partial + final hash
    aggregate, shuffled on the order key), the orders side is shuffled once on the
    same key so the left join is a co-partitioned sort-merge join (or a broadcast,
    if AQE measures the side small), then one shuffle on the customer key for the
    merchant name.  No side is hinted for broadcast: the threshold check and
    AQE's runtime statistics decide.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice")
    # fixed value: orders whose key ends in 7 are missing on the insurer side
    lt = (li.where(F.col("l_orderkey") % 10 != 7)
          .groupBy(F.col("l_orderkey").alias("k"))
          .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("pvi")))
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    k = F.col("k")
    b = (o.withColumnRenamed("o_orderkey", "k")
         .join(lt, "k", "left")
         .join(c, F.col("o_custkey") == F.col("c_custkey"), "inner")
         # fixed value: orders whose key ends in 3 are missing on the platform side
         .withColumn("gsm", F.when(k % 10 != 3, F.col("o_totalprice").cast(MONEY))))
    gsm, pvi = F.col("gsm"), F.col("pvi")
    secs = ((k % 86400) * (k % 86400)) % 86400
    order_time = F.when(k % 89 == 0, F.lit("bad")).otherwise(_wall_clock_text(F.col("o_orderdate"), secs))
    status = (F.when(k % 97 == 0, F.lit(None).cast("string"))
              .when(gsm.isNotNull() & pvi.isNotNull(), F.lit("match"))
              .when(pvi.isNotNull(), F.lit("not_found_in_m"))
              .otherwise(F.lit("not_found_in_external")))
    insurance = (F.when(F.col("o_orderstatus") == "F", "completed")
                 .when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled"))
    prio = F.col("o_orderpriority")
    service = (F.when(prio == "1-URGENT", "express").when(prio == "2-HIGH", "Express")
               .when(prio == "3-MEDIUM", "normal").when(prio == "5-LOW", "cargo"))
    seg = F.col("c_mktsegment")
    business = (F.when(seg == "BUILDING", "true").when(seg == "MACHINERY", "1")
                .when(seg == "HOUSEHOLD", "false").when(seg == "FURNITURE", "no"))
    merchant_amount = (F.when(k % 101 == 0, F.lit(0))
                       .when((k % 4 == 0) & pvi.isNotNull() & gsm.isNotNull(), gsm)
                       .otherwise(pvi)).cast(MONEY)
    return (b.where(gsm.isNotNull() | pvi.isNotNull())
            .select(F.concat(F.lit("O"), k.cast("string")).alias("order_id"),
                    F.col("c_name").alias("merchant"),
                    F.col("o_orderdate").cast("date").alias("biz_date"),
                    order_time.alias("order_time"),
                    status.alias("reconcile_status"),
                    insurance.alias("insurance_status"),
                    service.alias("service_type"),
                    business.alias("is_business_order"),
                    gsm.alias("gsm_amount"),
                    merchant_amount.alias("merchant_amount"),
                    F.coalesce(gsm, pvi).cast(MONEY).alias("amount")))


def driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver-order table: one row per line item (order ids repeat)."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                    "l_returnflag", "l_linestatus")
    return _driver_columns(li).drop("l_linenumber")


def _driver_columns(li: DataFrame) -> DataFrame:
    ln, qty, tax = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_tax")
    rf = F.col("l_returnflag")
    return li.select(
        ln,
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), ln.cast("string")).alias("order_id"),
        F.when(ln <= 3, 100).when(ln <= 6, 200).when(tax < 0.04, 150).cast(MONEY).alias("gsm_amount"),
        F.when(qty <= 20, 100).when(qty <= 40, 200).otherwise(0).cast(MONEY).alias("merchant_amount"),
        F.when(F.col("l_linestatus") == "F", "match").when(rf == "R", "not_found_in_m")
        .otherwise("not_found_in_external").alias("reconcile_status"),
        F.when(tax >= 0.07, "SUCCESS").when(rf == "A", "COMPLETED").when(rf == "R", "FAILED")
        .otherwise("network_error").alias("merchant_status"),
    )


def ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two ledgers of line items, insurer and platform: ids repeat, one id holds a third of all
    rows, some platform rows have no id."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    k = F.col("l_orderkey")
    order = F.when(k % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("O"), k.cast("string")))
    amount = F.col("l_extendedprice").cast(MONEY).alias("amount")
    insurer = li.where(k % 10 != 7).select(order.alias("order_id"), amount)
    platform = li.where(F.col("l_linenumber") % 3 != 0).select(F.when(k % 50 != 1, order).alias("order_id"), amount)
    return insurer, platform


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of day files shaped like a ``binaryFile`` listing (path, length).

    One file per (order date, data set, version): urgent/high priority orders go to
    the driver data set, pending orders to a ``_2`` re-issue.  Odd days use an
    unpadded month folder.  ``length`` is the order value in cents.
    """
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority", "o_orderstatus",
                   "o_totalprice")
    files = (o.groupBy(
        F.col("o_orderdate").cast("date").alias("d"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "taixe").otherwise("reconciled")
        .alias("ds"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("ver"))
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("value")))
    d = F.col("d")
    month = F.month(d).cast("string")
    month_dir = F.when(F.dayofmonth(d) % 2 == 1, month).otherwise(F.lpad(month, 2, "0"))
    prefix = F.when(F.col("ds") == "taixe", S.FILE_PREFIXES["taixe"]).otherwise(S.FILE_PREFIXES["reconciled"])
    name = F.concat(prefix, F.translate(d.cast("string"), "-", ""),
                    F.when(F.col("ver") == 2, "_2").otherwise(""), F.lit(".csv"))
    path = F.concat_ws("/", F.lit("base"), F.year(d).cast("string"), month_dir,
                       F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), name)
    return files.select(path.alias("path"), (F.col("value") * 100).cast("bigint").alias("length"))


# Header spellings of the three slices; the value order follows each header.
HEADER_VARIANTS = [
    ["ORDER_ID", "GSM_AMOUNT", "MERCHANT_AMOUNT", "RECONCILE_STATUS", "MERCHANT_STATUS"],
    ["Reconcile Status", "ORDER_ID", "Merchant Status", "GSM Amount", "Merchant Amount"],
    ["MERCH_STATUS", "RECONCILE STATUS", "ORDER_ID", "Merchant Amount", "GSM_AMO"],
]
_VARIANT_FIELDS = {
    "ORDER_ID": "order_id", "GSM_AMOUNT": "gsm_amount", "GSM Amount": "gsm_amount", "GSM_AMO": "gsm_amount",
    "MERCHANT_AMOUNT": "merchant_amount", "Merchant Amount": "merchant_amount",
    "RECONCILE_STATUS": "reconcile_status", "Reconcile Status": "reconcile_status",
    "RECONCILE STATUS": "reconcile_status", "MERCHANT_STATUS": "merchant_status",
    "Merchant Status": "merchant_status", "MERCH_STATUS": "merchant_status",
}


def header_slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``driver`` rows as positional string arrays under three header spellings.

    Returns ``(rows, headers)``: rows are ``(path, v array<string>)``; headers are
    ``(path, h array<string>)``, one per slice - the same shape the CSV ingest
    produces before alias resolution.  The slice is ``line number % 3``.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                    "l_returnflag", "l_linestatus")
    drv = _driver_columns(li).withColumn("slice", F.col("l_linenumber") % 3)
    as_text = {c: F.col(c).cast("string") for c in
               ["order_id", "gsm_amount", "merchant_amount", "reconcile_status", "merchant_status"]}
    v = F.col("slice")
    arrays = None
    for i, hdr in enumerate(HEADER_VARIANTS):
        arr = F.array(*[as_text[_VARIANT_FIELDS[h]] for h in hdr])
        arrays = F.when(v == i, arr) if arrays is None else arrays.when(v == i, arr)
    rows = drv.select(F.concat(F.lit("slice_"), v.cast("string"), F.lit(".csv")).alias("path"),
                      arrays.alias("v"))
    headers = spark.createDataFrame(
        [(f"slice_{i}.csv", hdr) for i, hdr in enumerate(HEADER_VARIANTS)], "path string, h array<string>")
    return rows, headers
