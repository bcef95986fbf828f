"""The silver table: typed Parquet by day, kept up to date with the drops.

Layout below ``silver_path``::

    data/generation=<g>/biz_date=<day>/   rows, written once and never changed
    _state/<g>/                           one row a day: which generation holds its rows, and from which file
    _metrics/<g>/                         what the load of a generation mended

*What changed.*  The state is a catalogue that persists each day's chosen file by name, length and
modification time.  :func:`changed_days` compares it with the present listing in a full outer
join, so new days, re-issues, files rewritten in place and files that are gone all count, and a
day that is as it was is not read again.

*Atomic replace.*  A refresh writes the rows of all changed days to a new generation and then
makes one state visible by a rename.  Readers join the state, so they see all days of a
refresh or none; a table that was read before goes on with the rows of its own state, as no
file is overwritten or deleted.  A refresh that stops half-way leaves a generation that no
state names.  Two refreshes at once collide at the rename: the second fails and may run again.
:func:`vacuum` removes what only old states name.

*Types.*  Unlisted columns are stored as text, with the type state of each day and column
(:mod:`ledgerlens.sources.inference`) in the table's state: a reader merges the states of the
days it reads, so no day is rewritten when another widens a column, and no footer is opened to
find the columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import csv_ingest as I
from .inference import column_states, quoted, type_of

DAYS = ("biz_date date, generation int, path string, length bigint, modification_time timestamp, version int, rows bigint, "
        "columns array<struct<column:string, cells:bigint, mask:int>>")
METRICS = "generation int, metric string, column string, value bigint"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def sub_numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """Numbers that name the sub-folders of ``folder``, in order."""
    fs, p = _hadoop(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def generations(spark: SparkSession, silver_path: str) -> list[int]:
    """Generations that are visible, oldest first."""
    return sub_numbers(spark, f"{silver_path.rstrip('/')}/_state")


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in one step, unless the target exists (a rename would move below it)."""
    fs, to = _hadoop(spark, target)
    return not fs.exists(to) and bool(fs.rename(_hadoop(spark, source)[1], to))


def generation_rows(spark: SparkSession, silver_path: str, generation: int, dataset: str = "reconciled") -> DataFrame:
    """The rows that a generation holds, listed columns only."""
    listed = I.spec_for(dataset)
    fields = [T.StructField(c, listed.types.get(c, T.StringType())) for c in listed.columns] + [T.StructField("biz_date", T.DateType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{silver_path.rstrip('/')}/data/generation={generation}")


def days(spark: SparkSession, silver_path: str, *, as_of: int | None = None) -> DataFrame:
    """The state: one row a day of the table (of the newest generation, or of ``as_of``)."""
    seen = [g for g in generations(spark, silver_path) if as_of is None or g <= as_of]
    if not seen:
        return spark.createDataFrame([], DAYS)
    return spark.read.schema(DAYS).parquet(f"{silver_path.rstrip('/')}/_state/{seen[-1]}")


def _within(df: DataFrame, date_from=None, date_to=None, some: Sequence | None = None) -> DataFrame:
    day = F.col("biz_date")
    for given, keep in ((date_from, lambda x: day >= F.lit(x).cast("date")), (date_to, lambda x: day <= F.lit(x).cast("date")),
                        (some, lambda x: day.isin(list(x)))):
        df = df if given is None else df.where(keep(given))
    return df


def changed_days(listed: DataFrame, known: DataFrame) -> DataFrame:
    """``(biz_date, change, path, length, modification_time, version)`` of the days that differ between the
    chosen files and the table's state; ``change`` is ``added``, ``removed`` or ``rewritten``."""
    name = lambda c: F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    file = ["path", "length", "modification_time", "version"]
    old = known.select(F.col("biz_date").alias("_day"), *[F.col(c).alias(f"_{c}") for c in file])
    both = listed.select("biz_date", *file).join(old, F.col("biz_date") == F.col("_day"), "full_outer")
    same = (name("path").eqNullSafe(name("_path")) & F.col("length").eqNullSafe(F.col("_length"))
            & F.col("modification_time").eqNullSafe(F.col("_modification_time")))
    change = F.when(F.col("_day").isNull(), "added").when(F.col("biz_date").isNull(), "removed").when(~same, "rewritten")
    return (both.withColumn("change", change).where("change is not null")
            .select(F.coalesce("biz_date", "_day").alias("biz_date"), "change", *file))


def refresh_silver(spark: SparkSession, base_path: str, silver_path: str, dataset: str = "reconciled", *, days: Sequence | None = None,
                   date_from=None, date_to=None, versions: tuple[int, ...] | None = S.FILE_VERSIONS, multi_line: bool = False,
                   header_source: str = "auto") -> int | None:
    """Bring the days of a range (or ``days``; all by default) in line with their latest files.

    Only files of days that changed are read.  Returns the new generation, None if nothing
    changed.  The changed days, at most one row for each day of the range, go through the driver.
    """
    silver = silver_path.rstrip("/")
    some = days
    if some is not None and some:
        date_from, date_to = min(some), max(some)
    root = I.month_root(base_path, date_from, date_to)
    listing = I.listed_below(spark, base_path, root)
    if listing is None:
        listing = spark.createDataFrame([], "path string, length bigint, modification_time timestamp")
    chosen = I.chosen_files(spark, base_path, dataset, date_from=date_from, date_to=date_to, days=some, versions=versions, listing=listing)
    state = _state(spark, silver)
    changes = changed_days(chosen, _within(state, date_from, date_to, some)).collect()
    if not changes:
        return None
    generation = max([0, *generations(spark, silver), *sub_numbers(spark, f"{silver}/data", "generation=")]) + 1
    new = [c for c in changes if c.path is not None]
    rows = spark.createDataFrame([], DAYS)
    accounting = I.Accounting()
    if new:
        whole = len(new) == chosen.count()      # then one listing of the range does, else the files by name
        files = spark.createDataFrame([(c.path,) for c in new], "path string")
        loaded = I.load_files(files, dataset, root if whole else [c.path for c in new], multi_line=multi_line, header_source=header_source,
                              infer_types=False, accounting=accounting)
        target = f"{silver}/data/generation={generation}"
        loaded.write.partitionBy("biz_date").parquet(target)
        written = spark.read.schema(loaded.schema).parquet(target)
        rows = _new_days(spark, written, new, dataset, generation)
    metrics = [(generation, *m) for m in accounting.counts()] + [
        (generation, f"days_{k}", None, sum(c.change == k for c in changes)) for k in ("added", "rewritten", "removed")]
    spark.createDataFrame(metrics, METRICS).coalesce(1).write.parquet(f"{silver}/_metrics/{generation}")
    gone = [c.biz_date for c in changes]
    commit(spark, silver, generation, state.where(~F.col("biz_date").isin(gone)).union(rows))
    return generation


def _state(spark: SparkSession, silver: str) -> DataFrame:
    return days(spark, silver)


def _new_days(spark: SparkSession, written: DataFrame, new: list, dataset: str, generation: int) -> DataFrame:
    """State rows of the days in ``new``: their rows and unlisted columns as ``written``."""
    others = [c for c in written.columns if c not in I.spec_for(dataset).columns and c not in ("source_file", "dataset", "version", "biz_date")]
    files = spark.createDataFrame([(c.biz_date, c.path, c.length, c.modification_time, c.version) for c in new],
                                  "biz_date date, path string, length bigint, modification_time timestamp, version int")
    counts = written.groupBy("biz_date").agg(F.count(F.lit(1)).alias("rows"))
    states = column_states(written, others, by=["biz_date"])
    if others:      # a column without a cell is a column, too
        named = files.select("biz_date", F.explode(F.array(*map(F.lit, others))).alias("column"))
        states = named.join(states, ["biz_date", "column"], "left").withColumn("cells", F.coalesce("cells", F.lit(0).cast("long")))
    states = states.groupBy("biz_date").agg(F.sort_array(F.collect_list(F.struct("column", "cells", "mask"))).alias("columns"))
    return (files.join(counts, "biz_date", "left").join(states, "biz_date", "left")
            .select("biz_date", F.lit(generation).alias("generation"), "path", "length", "modification_time", "version",
                    F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "columns"))


def commit(spark: SparkSession, silver_path: str, generation: int, state: DataFrame) -> None:
    """Make ``state`` the table's: written aside, then renamed in one step."""
    silver = silver_path.rstrip("/")
    aside = f"{silver}/_state/_writing-{generation}-{uuid.uuid4().hex}"
    state.coalesce(1).write.parquet(aside)
    if not rename(spark, aside, f"{silver}/_state/{generation}"):
        raise RuntimeError(f"another refresh has made generation {generation} of {silver}")


def read_silver(spark: SparkSession, silver_path: str, dataset: str = "reconciled", *, date_from=None, date_to=None,
                as_of: int | None = None, infer_types: bool = True) -> DataFrame:
    """The table, with the columns of all days read: listed ones in their types, then the others.

    The state (one row a day) is joined on both partition columns, so folders of other
    generations and days are pruned; a range prunes them while planning.
    """
    silver = silver_path.rstrip("/")
    state = _within(days(spark, silver, as_of=as_of), date_from, date_to)
    listed = I.spec_for(dataset)
    found = (state.select(F.inline("columns")).groupBy(F.lower("column").alias("_key"))
             .agg(F.min("column").alias("column"), F.bit_and("mask").alias("mask")).orderBy("column").collect())   # spellings of one name are one column
    types = {c: listed.types.get(c, T.StringType()) for c in listed.columns}
    fields = [*(T.StructField(c, t) for c, t in types.items()), *(T.StructField(r["column"], T.StringType()) for r in found),
              T.StructField("source_file", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("version", T.IntegerType()),
              T.StructField("generation", T.IntegerType()), T.StructField("biz_date", T.DateType())]
    others = [quoted(r["column"]).try_cast(type_of(r["mask"])).alias(r["column"]) if infer_types else quoted(r["column"]) for r in found]
    fs, folder = _hadoop(spark, f"{silver}/data")
    if not fs.exists(folder):
        rows = spark.createDataFrame([], T.StructType(fields))
    else:
        rows = _within(spark.read.schema(T.StructType(fields)).parquet(f"{silver}/data"), date_from, date_to)
        rows = rows.join(state.where("rows > 0").select("generation", "biz_date"), ["generation", "biz_date"], "left_semi")
    return rows.select(*listed.columns, *others, "source_file", "biz_date", "dataset", "version")


def metrics(spark: SparkSession, silver_path: str) -> DataFrame:
    """``(generation, metric, column, value)`` of every visible generation: files, header-less files, rows,
    ragged rows, bad cells by column, days added, rewritten and removed."""
    silver = silver_path.rstrip("/")
    seen = generations(spark, silver)
    return spark.read.schema(METRICS).parquet(*[f"{silver}/_metrics/{g}" for g in seen]) if seen else spark.createDataFrame([], METRICS)


def vacuum(spark: SparkSession, silver_path: str, *, keep: int = 2) -> int:
    """Delete the rows that none of the newest ``keep`` states names, and older states.  Returns the number of
    day folders deleted.  Call it when no reader of an older state is left."""
    silver = silver_path.rstrip("/")
    seen = generations(spark, silver)
    kept = seen[-max(keep, 1):]
    named = {(r.generation, str(r.biz_date)) for g in kept for r in days(spark, silver, as_of=g).select("generation", "biz_date").collect()}
    deleted = 0
    for g in sub_numbers(spark, f"{silver}/data", "generation="):
        if not seen or g > seen[-1]:            # a refresh may be writing it
            continue
        fs, folder = _hadoop(spark, f"{silver}/data/generation={g}")
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("biz_date=") and (g, name.removeprefix("biz_date=")) not in named:
                deleted += bool(fs.delete(status.getPath(), True))
    for g in sub_numbers(spark, f"{silver}/partials", "generation="):
        if seen and g <= seen[-1] and g not in {n for n, _ in named}:
            fs, folder = _hadoop(spark, f"{silver}/partials/generation={g}")
            fs.delete(folder, True)
    for g in seen[:-max(keep, 1)]:
        fs, folder = _hadoop(spark, f"{silver}/_state/{g}")
        fs.delete(folder, True)
    return deleted
