"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver tables through :mod:`ledgerlens.plans.fixtures` (so its
work grows with them) and returns the whole result; limits appear only where
they are the feature (``sample_head``, ``page_rows``, ``peak_hour``).  The
equivalent DuckDB SQL lives in :mod:`ledgerlens.plans.oracle` under the same key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates as A
from ..operators import filters as Fl
from ..operators import ordering as O
from ..operators import partials as P
from ..operators.ledgers import reconcile_ledgers
from ..functions.labels import parse_order_time
from ..operators import report as R
from ..session import scratch_path
from ..sources import by_id as B
from ..sources import catalog as C
from ..sources import csv_ingest as I
from ..sources import silver as V
from ..sources import sinks
from ..sources.tables import read_table
from . import fixtures as X
from .drops import delete_files, write_daily_drops, write_line_drops

Query = Callable[[SparkSession, str], DataFrame]

# Amount columns present in the ``recon`` fixture.
RECON_AMOUNTS = ("gsm_amount", "merchant_amount", "amount")


def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id list as typed by a user: one id per line, padded, with blank lines.

    Ids of orders having a returned first line item, plus ids that do not exist
    (``X<key>``), plus blank lines.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    k = F.col("l_orderkey").cast("string")
    return li.where((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")).select(
        F.explode(F.array(F.concat(F.lit("  O"), k, F.lit(" ")), F.concat(F.lit("X"), k), F.lit("   ")))
        .alias("line"))


def merchant_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants picked in the drill-down filter: customers of two market segments."""
    c = read_table(spark, sf_dir, "customer", "c_name", "c_mktsegment")
    return c.where(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")).select(F.col("c_name").alias("merchant"))


class Tables:
    """Where the registered operators get their inputs.

    :class:`FixtureTables` derives them from the driver tables on every call (the
    form the SQL oracle mirrors); :class:`SilverTables` reads a materialized copy,
    which is how the analyses run in production (bronze CSV -> silver Parquet ->
    operators).
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def recon(self) -> DataFrame:
        return X.recon(self.spark, self.sf_dir)

    def driver(self) -> DataFrame:
        return X.driver(self.spark, self.sf_dir)

    def catalog(self) -> DataFrame:
        return X.file_catalog(self.spark, self.sf_dir)

    def header_slices(self) -> tuple[DataFrame, DataFrame]:
        return X.header_slices(self.spark, self.sf_dir)

    def lookup_ids(self) -> DataFrame:
        return lookup_ids(self.spark, self.sf_dir)

    def ledgers(self) -> tuple[DataFrame, DataFrame]:
        return X.ledgers(self.spark, self.sf_dir)

    def merchant_selection(self) -> DataFrame:
        return merchant_selection(self.spark, self.sf_dir)


FixtureTables = Tables


class SilverTables(Tables):
    """Materialized ``recon`` / ``driver`` / catalogue tables under ``silver_dir``."""

    NAMES = ("recon", "driver", "catalog")

    def __init__(self, spark: SparkSession, sf_dir: str, silver_dir: str):
        super().__init__(spark, sf_dir)
        self.silver_dir = silver_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def build(cls, spark: SparkSession, sf_dir: str, silver_dir: str) -> "SilverTables":
        src = Tables(spark, sf_dir)
        root = silver_dir.rstrip("/")

        def write(name: str) -> None:
            df = getattr(src, name)()
            if "order_time" in df.columns:      # silver times are typed
                df = df.withColumn("order_time", parse_order_time("order_time"))
            df.write.mode("overwrite").parquet(f"{root}/{name}")

        # independent tables: submit the three write jobs side by side so the
        # scheduler fills the cores one job's tail stages leave idle
        with ThreadPoolExecutor(max_workers=len(cls.NAMES)) as pool:
            list(pool.map(write, cls.NAMES))
        return cls(spark, sf_dir, silver_dir)

    def _read(self, name: str) -> DataFrame:
        # one lazy DataFrame per table, reused by every operator: the file listing
        # and Parquet footer are read once (no data is cached)
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.silver_dir}/{name}")
        return self._frames[name]

    def recon(self) -> DataFrame:
        return self._read("recon")

    def driver(self) -> DataFrame:
        return self._read("driver")

    def catalog(self) -> DataFrame:
        return self._read("catalog")


def _alias_resolve(t: Tables) -> DataFrame:
    rows, headers = t.header_slices()
    # three literal header rows: a proven size bound, so the header table is broadcast
    typed = I.resolve_positional(rows, headers, I.driver_spec(), broadcast_headers=True)
    return typed.select("order_id", "reconcile_status",
                        F.col("gsm_amount").cast("double").alias("gsm_amount"),
                        F.col("merchant_amount").cast("double").alias("merchant_amount"),
                        "merchant_status")


def _drilldown_filtered(t: Tables) -> DataFrame:
    drill = Fl.status_drilldown(t.recon())
    return Fl.drilldown_filtered(drill, merchants=t.merchant_selection(), services=["express", "Express"])


def _parsed(t: Tables) -> DataFrame:
    return C.parse_paths(t.catalog())


def _scratch(t: Tables, name: str) -> str:
    return scratch_path(t.spark, f"{name}-{uuid.uuid4().hex}")


def _csv_load(t: Tables) -> DataFrame:
    """The transactions as daily CSV files in two header layouts, loaded again."""
    base = _scratch(t, "drops")
    write_daily_drops(t.recon(), f"{base}/drops", f"{base}/staging")
    return I.load(t.spark, f"{base}/drops", "reconciled").select(
        "order_id", "merchant", "amount", "order_time", "reconcile_status", "insurance_status", "is_business_order", "service_type",
        "gsm_amount", "merchant_amount", "biz_date", "dataset", "version")


#: Columns that no alias names, as (column, header) of a daily file.
OTHER_HEADERS = [("order_id", "ORDER_ID"), ("order_no", "Order No"), ("rate", "Rate.1"), ("late", "Late"), ("mixed", "Mixed"), ("half", "Half"),
                 ("blank", "Blank")]


def _inferred_types(t: Tables) -> DataFrame:
    """Types of the columns that no alias names, from all cells of daily files."""
    base, number = _scratch(t, "typed-drops"), F.substring("order_id", 2, 20)
    rows = t.recon().select(
        "order_id", "biz_date", number.alias("order_no"), F.col("amount").cast("string").alias("rate"),
        F.when(F.col("insurance_status") == "pending", "true").otherwise("False").alias("late"),
        F.coalesce(F.when(F.col("reconcile_status").isNotNull(), number), F.lit("n/a")).alias("mixed"),
        F.when(F.col("gsm_amount").isNotNull(), F.when(number.cast("long") % 4 == 0, F.concat(number, F.lit(".5"))).otherwise(number)).alias("half"),
        F.lit(None).cast("string").alias("blank"))
    write_daily_drops(rows, f"{base}/drops", f"{base}/staging", headers=[OTHER_HEADERS, OTHER_HEADERS[::-1]])
    loaded = I.load(t.spark, f"{base}/drops", "reconciled")
    return A.column_profile(loaded, columns=[h for _, h in OTHER_HEADERS[1:]])


def _silver_refresh(t: Tables) -> DataFrame:
    """A silver table after days were rewritten in place, re-issued and deleted, and the days
    that each refresh touched."""
    base, table = _scratch(t, "refresh-drops"), _scratch(t, "refresh-silver")
    t.recon().write.parquet(f"{base}/recon")
    recon, drops, day = t.spark.read.parquet(f"{base}/recon"), f"{base}/drops", F.dayofmonth("biz_date") % 10
    write_daily_drops(recon, drops, f"{base}/first")
    V.refresh_silver(t.spark, drops, table)
    write_daily_drops(recon.where(day == 3).withColumn("amount", F.col("amount") + 1), drops, f"{base}/rewritten")
    write_daily_drops(recon.where(day == 5).withColumn("amount", F.col("amount") * 2), drops, f"{base}/reissued", suffix="_2")
    gone = C.parse_paths(C.list_files(t.spark, drops)).where(day == 7).select("path").collect()        # a day each
    delete_files(t.spark, [r.path for r in gone])
    V.refresh_silver(t.spark, drops, table)
    rows = V.read_silver(t.spark, table).withColumn("item", F.concat_ws("@", "order_id", F.col("version").cast("string")))
    touched = V.metrics(t.spark, table).where(F.col("column").isNull()).withColumn("item", F.concat_ws(":", F.col("generation").cast("string"), "metric"))
    return _long([("row", rows, "item", "amount"), ("metric", touched, "item", "value")])


def _ingest_accounting(t: Tables) -> DataFrame:
    """What a refresh mends, over files with bad cells, ragged rows and, on the 31st, no header."""
    base, table = _scratch(t, "untidy-drops"), _scratch(t, "untidy-silver")
    k = F.substring("order_id", 2, 20).cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [F.col("order_id"), F.lit('"a ""quoted"", cell"'), F.when(k % 7 == 0, "n/a").otherwise(text("amount")), text("order_time"), text("reconcile_status")]
    line = F.when(k % 11 == 0, F.concat_ws(",", *cells, F.lit("more"))).when(k % 13 == 0, F.concat_ws(",", *cells[:-1])).otherwise(F.concat_ws(",", *cells))
    rows = t.recon().select("biz_date", k.alias("place"), line.alias("line"))
    head = F.when(F.dayofmonth("biz_date") == 31, "a,b,c,d,e").otherwise("ORDER_ID,MERCHANT,TOTAL_AMOUNT,ORDER_TIME,RECONCILE_STATUS")
    heads = rows.select("biz_date").distinct().select("biz_date", F.lit(-1).cast("long").alias("place"), head.alias("line"))
    write_line_drops(rows.union(heads), f"{base}/drops", f"{base}/staging")
    V.refresh_silver(t.spark, f"{base}/drops", table)
    return V.metrics(t.spark, table).drop("generation")


def _by_id(t: Tables, df: DataFrame) -> DataFrame:
    path = _scratch(t, "by-id")
    B.write_by_id(df, path, buckets=8)
    return B.read_by_id(t.spark, path)


def _page_at(t: Tables) -> DataFrame:
    """L3: a page by its number, from a key index."""
    path = _scratch(t, "page-index")
    O.write_page_index(t.recon(), path)
    return O.page_at(t.recon(), t.spark.read.parquet(path), 12, 100)


def _partials_report(t: Tables) -> DataFrame:
    """A1-A9 from a written table of daily partials."""
    path = _scratch(t, "partials")
    P.daily_partials(t.recon()).write.parquet(path)
    p = P.Partials(t.spark.read.parquet(path))
    both = F.concat_ws("/", "amount_type", "service_label")
    return _long([("summary", p.reconcile_status_summary(), "reconcile_status", "total_amount"),
                  ("status", p.reconcile_status_distribution(), "reconcile_status", "percent"), ("insurance", p.insurance_distribution(), "insurance_status", "percent"),
                  ("business", p.business_distribution(), "business_label", "percent"), ("service", p.service_type_distribution(), "service_label", "percent"),
                  ("amounts", p.amount_by_service(RECON_AMOUNTS).withColumn("item", both), "item", "total_amount"),
                  ("overall", p.amount_overall(RECON_AMOUNTS), "amount_type", "avg_amount"), ("merchant", p.merchant_patterns(), "merchant", "match_rate"),
                  ("hour", p.hourly_patterns(), "hour", "transaction_count")])


def _csv_export(t: Tables) -> DataFrame:
    """K1: the drill-down exported by status and month, read back."""
    drill = Fl.status_drilldown(t.recon()).withColumn("month", F.date_format("biz_date", "yyyy-MM"))
    path = sinks.export_drilldown(drill, _scratch(t, "export"), date_col="month")
    back = t.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("order_id", "reconcile_status", "merchant", F.col("amount").cast("double").alias("amount"), "export")


def _discrepancy_report(t: Tables) -> DataFrame:
    """K2: the four sections written, read back in one tagged long form."""
    paths = sinks.write_report(t.recon(), _scratch(t, "report"))
    shown = {"insurer_only": ("order_id", "amount"), "platform_only": ("order_id", "amount"),
             "amount_mismatch": ("order_id", "amount_diff"), "summary": ("reconcile_status", "total_amount")}
    return _long([(name, t.spark.read.parquet(path), *shown[name]) for name, path in paths.items()])


def _long(parts) -> DataFrame:
    """``(part, item, value)`` of several frames."""
    rows = [df.select(F.lit(name).alias("part"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
            for name, df, item, value in parts]
    out = rows[0]
    for part in rows[1:]:
        out = out.union(part)
    return out


def _full_report(t: Tables) -> DataFrame:
    """Every part of the report in one tagged long form."""
    shown = {"summary": ("reconcile_status", "order_count"), "insurer_only": ("order_id", "amount"), "platform_only": ("order_id", "amount"),
             "amount_mismatch": ("order_id", "amount_diff"), "merchant_analysis": ("merchant", "match_rate"),
             "hourly": ("hour", "transaction_count"), "peak_hour": ("hour", "transaction_count"), "suspicious": ("item", "metric"),
             "recommendations": ("rule", "value")}
    report = R.reconciliation_report(t.recon())
    return _long([(name, report[name], *shown[name]) for name in shown])


def _repeated(t: Tables) -> DataFrame:
    """Transactions in which the ids of every month's first day occur twice."""
    recon = t.recon()
    return recon.union(recon.where(F.dayofmonth("biz_date") == 1))


# key -> operator over the tables
OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    # transactions (recon)
    "reconcile_status_distribution": lambda t: A.reconcile_status_distribution(t.recon()),
    "reconcile_status_summary": lambda t: A.reconcile_status_summary(t.recon()),
    "reconcile_status_by_day": lambda t: A.reconcile_status_distribution(t.recon(), by=["biz_date"]),
    "insurance_distribution": lambda t: A.insurance_distribution(t.recon()),
    "business_distribution": lambda t: A.business_distribution(t.recon()),
    "business_rate": lambda t: A.business_rate(t.recon()),
    "service_type_distribution": lambda t: A.service_type_distribution(t.recon()),
    "service_type_summary": lambda t: A.service_type_summary(t.recon()),
    "amount_by_service": lambda t: A.amount_by_service(t.recon(), amount_cols=RECON_AMOUNTS),
    "amount_overall": lambda t: A.amount_overall(t.recon(), amount_cols=RECON_AMOUNTS),
    "amount_comparison_matrix": lambda t: A.amount_comparison_matrix(t.recon(), amount_cols=RECON_AMOUNTS),
    "merchant_patterns": lambda t: A.merchant_patterns(t.recon()),
    "unusual_merchants": lambda t: A.unusual_merchants(A.merchant_patterns(t.recon(), sort=False)),
    "hourly_patterns": lambda t: A.hourly_patterns(t.recon()),
    "peak_hour": lambda t: A.peak_hour(A.hourly_patterns(t.recon(), sort=False)),
    "summary_stats": lambda t: A.summary_stats(t.recon()),
    "summary_stats_by_day": lambda t: A.summary_stats(t.recon(), by=["biz_date"]),
    "one_sided_m": lambda t: Fl.one_sided(t.recon(), "m"),
    "one_sided_external": lambda t: Fl.one_sided(t.recon(), "external"),
    "amount_mismatch": lambda t: Fl.amount_mismatch(t.recon()),
    "high_amount_discrepancy": lambda t: Fl.high_amount_discrepancy(t.recon()),
    "status_drilldown": lambda t: Fl.status_drilldown(t.recon()),
    "drilldown_filtered": _drilldown_filtered,
    "drilldown_kpis": lambda t: A.drilldown_kpis(t.recon()),
    "order_lookup": lambda t: Fl.order_lookup(t.recon(), t.lookup_ids()),
    "sample_head": lambda t: Fl.sample_head(t.recon(), 100),
    "page_rows": lambda t: Fl.page_rows(t.recon(), page=2, size=100),
    "page_count": lambda t: Fl.page_count(t.recon(), size=500),
    "page_after_key": lambda t: Fl.page_after(t.recon(), "O5000", 100),
    "column_profile": lambda t: A.column_profile(t.recon()),
    "suspicious_summary": lambda t: R.suspicious_summary(t.recon()),
    "recommendations": lambda t: R.recommendations(t.recon()),
    "suspicious_summary_repeats": lambda t: R.suspicious_summary(_repeated(t)),
    "recommendations_repeats": lambda t: R.recommendations(_repeated(t)),
    "full_report": _full_report,
    # driver orders
    "vehicle_distribution": lambda t: A.vehicle_distribution(t.driver()),
    "vehicle_amount_comparison": lambda t: A.vehicle_amount_comparison(t.driver()),
    "merchant_status_distribution": lambda t: A.merchant_status_distribution(t.driver()),
    "failed_rollup": lambda t: A.failed_rollup(t.driver()),
    "duplicate_orders": lambda t: A.duplicate_orders(t.driver()),
    "failed_orders": lambda t: Fl.failed_orders(t.driver()),
    # file catalogue
    "date_from_path": lambda t: _parsed(t).select("path", "folder_date", "dataset", "name_date", "version",
                                                  "biz_date"),
    "latest_version_per_key": lambda t: C.latest_versions(_parsed(t)),
    "availability_calendar": lambda t: C.availability_calendar(_parsed(t)),
    "catalog_inventory": lambda t: C.inventory(_parsed(t)),
    "catalog_inventory_by_month": lambda t: C.inventory(_parsed(t), by_month=True),
    "date_folders": lambda t: C.date_folders(_parsed(t)),
    # header drift
    "alias_resolve": _alias_resolve,
    # two ledgers, days
    "reconcile_ledgers": lambda t: reconcile_ledgers(*t.ledgers(), hot_rows=10_000),
    "daily_trend": lambda t: P.day_over_day(P.daily_partials(t.recon())),
}


# key -> operators that write files and read them again (timed apart in the bench)
ROUND_TRIPS: dict[str, Callable[[Tables], DataFrame]] = {
    "csv_load": _csv_load,
    "inferred_types": _inferred_types,
    "silver_refresh": _silver_refresh,
    "ingest_accounting": _ingest_accounting,
    "page_at": _page_at,
    "order_lookup_by_id": lambda t: B.lookup(_by_id(t, t.recon()), t.lookup_ids()),
    "duplicate_orders_by_id": lambda t: A.duplicate_orders(_by_id(t, t.driver())),
    "summary_stats_by_id": lambda t: A.summary_stats(_by_id(t, t.recon())),
    "partials_report": _partials_report,
    "csv_export": _csv_export,
    "discrepancy_report": _discrepancy_report,
}


def money_as_double(df: DataFrame) -> DataFrame:
    """Registered results present exact decimal money as double (the last step,
    so every sum above it stays exact); other columns are unchanged."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def queries() -> dict[str, Query]:
    """``(spark, sf_dir) -> DataFrame`` per key, deriving the inputs from the driver tables."""
    def bind(op):
        return lambda spark, sf_dir: money_as_double(op(FixtureTables(spark, sf_dir)))
    return {k: bind(op) for k, op in {**OPERATORS, **ROUND_TRIPS}.items()}
