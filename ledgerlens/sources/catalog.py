"""Catalogue of daily reconciliation files.

Files live in ``<base>/YYYY/MM/DD/`` (month and day may be unpadded) and are
named ``<prefix><YYYYMMDD>[_<n>].csv``; a ``_2`` file re-issues (replaces) the
day's base file.  The catalogue is a DataFrame of ``(path, length)`` rows - a
``binaryFile`` listing whose content column is pruned, so listing reads no file
bytes - and everything here is column expressions over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

# <transaction prefix>[<what the driver prefix adds>]<YYYYMMDD>[_<n>].csv
_NAME_RE = (f"^{S.FILE_PREFIXES['reconciled']}({S.FILE_PREFIXES['taixe'].removeprefix(S.FILE_PREFIXES['reconciled'])})?"
            r"([0-9]{8})(_([0-9]+))?\.csv$")


def list_files(spark: SparkSession, base_path: str, glob: str = "*.csv") -> DataFrame:
    """S1 listing: every CSV under ``base_path`` as ``(path, length, modification_time)``.  Spark's
    sources pass over files of zero bytes."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .load(base_path)
            .select("path", "length", F.col("modificationTime").alias("modification_time")))


def _zfill2(c):
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def _parts(path_col: str):
    """Path components (backslashes read as slashes)."""
    return F.split(F.translate(F.col(path_col), "\\", "/"), "/")


def _date_of(y, m, d):
    return F.when(F.length(y) > 0, F.try_to_date(F.concat(y, _zfill2(m), _zfill2(d)), "yyyyMMdd"))


def folder_date(path_col: str = "path"):
    """Business date from the last three folder names (backslashes allowed; 7 -> 07).

    An invalid or too short path gives null (the source gave an empty string).
    Components are taken with ``split`` (linear), not with a backtracking regex.
    """
    parts = _parts(path_col)
    y, m, d = (F.try_element_at(parts, F.lit(i)) for i in (-4, -3, -2))
    return _date_of(y, m, d)


def parse_paths(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``folder_date``, ``dataset``, ``name_date``, ``version`` and ``biz_date``.

    The data set is read from the file name with an anchored pattern (the driver
    prefix extends the transaction prefix).  ``biz_date`` is set only when the
    file name's date equals the folder's date, i.e. when the file is one the day
    folder can be asked for; other names are kept with ``biz_date = null``.  A number
    after the date that is no version (too long) gives a null version.
    """
    # stage 1: components, each computed once
    parts = _parts(path_col)
    staged = files.withColumns({
        "_y": F.try_element_at(parts, F.lit(-4)), "_m": F.try_element_at(parts, F.lit(-3)),
        "_d": F.try_element_at(parts, F.lit(-2)), "_name": F.try_element_at(parts, F.lit(-1))})
    name = F.col("_name")
    staged = staged.withColumns({
        "_hit": name.rlike(_NAME_RE),
        "_taixe": F.regexp_extract(name, _NAME_RE, 1),
        "_ndate": F.regexp_extract(name, _NAME_RE, 2),
        "_ver": F.regexp_extract(name, _NAME_RE, 4)})
    # stage 2: typed fields
    hit = F.col("_hit")
    out = staged.withColumns({
        "folder_date": _date_of(F.col("_y"), F.col("_m"), F.col("_d")),
        "dataset": F.when(hit, F.when(F.col("_taixe") != "", F.lit("taixe")).otherwise(F.lit("reconciled"))),
        "name_date": F.when(hit, F.try_to_date(F.col("_ndate"), "yyyyMMdd")),
        "version": F.when(hit, F.when(F.col("_ver") == "", F.lit(1)).otherwise(F.col("_ver").try_cast("int"))),
    })
    out = out.withColumn("biz_date", F.when(F.col("name_date") == F.col("folder_date"), F.col("folder_date")))
    return out.drop("_y", "_m", "_d", "_name", "_hit", "_taixe", "_ndate", "_ver")


def _accepted(parsed: DataFrame, versions: tuple[int, ...] | None) -> DataFrame:
    """Files of a day with an accepted version; the base file's version is written without a
    number, so a ``_1`` file is none of the contract's."""
    ok = parsed.where(F.col("biz_date").isNotNull() & F.col("version").isNotNull())
    if versions:
        ok = ok.where(F.col("version").isin(*versions) & ~F.col("path").endswith("_1.csv"))
    return ok


def latest_versions(parsed: DataFrame, *, versions: tuple[int, ...] | None = S.FILE_VERSIONS, keep: Sequence[str] = ()) -> DataFrame:
    """S3: per (biz_date, dataset) the highest version wins (replace, not append).

    ``versions`` are the accepted versions (``None``: any number).  One grouped ``max``
    over a ``(version, path, length)`` struct: no window, no sort of the catalogue.  ``keep``
    names further columns of the chosen file.
    """
    ok = _accepted(parsed, versions)
    best = F.max(F.struct("version", "path", "length", *keep)).alias("best")
    return (ok.groupBy("biz_date", "dataset").agg(best)
            .select("biz_date", "dataset", "best.version", "best.path", "best.length", *[f"best.{c}" for c in keep]))


def availability_calendar(parsed: DataFrame, *, require: str = "either",
                          large_mb: float = S.LARGE_FILE_MB,
                          versions: tuple[int, ...] | None = S.FILE_VERSIONS) -> DataFrame:
    """One row per day: chosen file, version and size of each data set.

    ``require``: ``reconciled`` (transaction file must exist), ``taixe`` (driver
    file must exist) or ``either``.  ``has_version_2`` is per data set: the chosen
    file's version is 2 or more.  Sizes are MiB; ``*_large`` marks > ``large_mb``.
    """
    # one aggregate per day: the max (version, path, length) of each data set is
    # its latest version, so no separate per-(day, data set) pass is needed
    cols = []
    for ds in ("reconciled", "taixe"):
        pick = F.max(F.when(F.col("dataset") == ds, F.struct("version", "path", "length")))
        cols.append(pick.alias(ds))
    day = _accepted(parsed, versions).groupBy("biz_date").agg(*cols)
    out = []
    for ds in ("reconciled", "taixe"):
        size = F.col(f"{ds}.length") / F.lit(1048576.0)
        out += [F.col(f"{ds}.path").alias(f"{ds}_path"),
                F.col(f"{ds}.version").alias(f"{ds}_version"),
                size.alias(f"{ds}_size_mb"),
                (size > F.lit(float(large_mb))).alias(f"{ds}_large"),
                (F.col(f"{ds}.version") >= 2).alias(f"{ds}_has_version_2")]
    res = day.select("biz_date", *out)
    cond = {"reconciled": F.col("reconciled_path").isNotNull(),
            "taixe": F.col("taixe_path").isNotNull(),
            "either": F.col("reconciled_path").isNotNull() | F.col("taixe_path").isNotNull()}[require]
    return res.where(cond)


def date_folders(parsed: DataFrame, *, year: int | None = None) -> DataFrame:
    """The distinct day folders (as dates) holding files, optionally of one year."""
    d = parsed.select("folder_date").where(F.col("folder_date").isNotNull()).distinct()
    if year is not None:
        d = d.where(F.year("folder_date") == int(year))
    return d.orderBy("folder_date")


def inventory(parsed: DataFrame, *, by_month: bool = False) -> DataFrame:
    """Day folders, files and total size (MiB), overall or per month."""
    keys = [F.date_trunc("month", F.col("folder_date")).cast("date").alias("month")] if by_month else []
    return parsed.groupBy(*keys).agg(
        F.count_distinct("folder_date").alias("day_count"),
        F.count(F.lit(1)).alias("file_count"),
        (F.sum("length") / F.lit(1048576.0)).alias("total_mb"))
