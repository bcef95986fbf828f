"""Sinks (K1, K2): distributed writes, nothing collected to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.aggs import ensure, quoted
from ..operators import aggregates as A
from ..operators import filters as Fl

ROWS_PER_FILE = 500_000          # of an export


def export_csv(df: DataFrame, path: str, *, partition_by: Sequence[str] | None = None,
               mode: str = "overwrite") -> str:
    """K1: CSV export (header, RFC-4180 quoting) written by the executors.

    ``partition_by=["biz_date"]`` writes one folder per day, so a drill-down over
    many days exports in one job.  Returns the output path.
    """
    w = (df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"')
         .option("timestampNTZFormat", S.ORDER_TIME_FORMAT))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def planned_files(named: DataFrame, *, rows_per_file: int, out: str = "part") -> DataFrame:
    """``named`` (with an ``export`` column) with the number, from 0, of each row's file.

    Rows are counted by name; a name gets as many files as its rows need, and a row goes to one by
    a hash of all its columns.  Only names with several files join the rows: there is at most one
    for every ``rows_per_file`` rows.
    """
    files = F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).cast("int")
    several = named.groupBy(F.col("export").alias("_name")).agg(files.alias("_files")).where("_files > 1")
    row = F.pmod(F.xxhash64(*map(quoted, named.columns)), F.coalesce("_files", F.lit(1))).cast("int")
    return named.join(several, F.col("export") == F.col("_name"), "left").withColumn(out, row).drop("_name", "_files")


def export_drilldown(df: DataFrame, path: str, *, status_col: str = "reconcile_status", date_col: str = "biz_date",
                     rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite") -> str:
    """K1: CSV export of a drill-down, a folder for each status and date, named
    ``export=<status>_details_<date>`` (``null`` for a missing one), with numbered files below
    (``part=0``, ``part=1``, ...) of about ``rows_per_file`` rows.

    Rows are hashed to tasks by name and number: a status with a third of all rows is written
    by many tasks, a small name by one.
    """
    df = ensure(df, status_col, date_col)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    named = df.withColumn("export", F.concat(text(status_col), F.lit("_details_"), text(date_col)))
    planned = planned_files(named, rows_per_file=rows_per_file)
    return export_csv(planned.repartition("export", "part"), path, partition_by=["export", "part"], mode=mode)


def write_report(df: DataFrame, path: str, *, fmt: str = "parquet", left: str = "gsm_amount",
                 right: str = "merchant_amount", mode: str = "overwrite", persist: bool = False) -> dict[str, str]:
    """K2: the discrepancy report as four outputs under ``path``.

    Sections: ``insurer_only``, ``platform_only``, ``amount_mismatch`` and
    ``summary``.  Every record is written (no display cap); an empty section is
    still written with its schema (Parquet keeps it).  With ``persist`` the base
    is kept (memory and disk) while the four writes run - useful for a costly
    lineage; over a Parquet table each section just reads its columns.
    """
    base = df.persist() if persist else df
    try:
        sections = {
            "insurer_only": Fl.one_sided(base, "m"),
            "platform_only": Fl.one_sided(base, "external"),
            "amount_mismatch": Fl.amount_mismatch(base, left=left, right=right),
            "summary": A.reconcile_status_summary(base),
        }
        out = {}
        for name, part in sections.items():
            target = f"{path.rstrip('/')}/{name}"
            writer = part.write.mode(mode)
            if fmt == "csv":
                writer = writer.option("header", "true").option("escape", '"').option("timestampNTZFormat", S.ORDER_TIME_FORMAT)
            writer.format(fmt).save(target)
            out[name] = target
        return out
    finally:
        if persist:
            base.unpersist()
