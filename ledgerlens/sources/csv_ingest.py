"""Typed loading of the daily CSV drops.

Headers drift between days: columns get reordered, renamed (``GSM_AMOUNT`` vs
``GSM Amount``) or truncated.  A typed CSV read with one schema would shift
columns silently (with ``enforceSchema``) or fail (without it), and inferring a
schema per file means one job per file.  Instead:

1. the catalogue picks the chosen (latest-version) files of the range from a
   listing of its month (or year) folders;
2. each file's header is its first record that is not blank, of any length.
   It is read by Spark's text source (any file system Spark reads); for local
   files by one small read per file in tasks over the file list;
3. the headers are one small row per file, written once.  A logical column is
   the cell at the position of its first alias present in the header (first hit
   wins); the widest header is the width of the scan, and every header cell that
   no alias names becomes a column of its own, by name over all files;
4. one pass over the data reads every row as a positional array of strings
   (the CSV reader skips each file's header line) and joins the per-file table,
   which also drops the rows of files that were not chosen;
5. null tokens become null and typed columns use ``try_cast``, so a bad cell
   becomes null and keeps its row.  A file without an ``ORDER_ID`` header loads
   with a null id (:func:`rejected_files` lists such files).  Columns that no alias
   names get the narrowest type that holds all their cells
   (:mod:`ledgerlens.sources.inference`): a scan of these columns, only if there are any;
6. on request the pass counts what it mends: ragged rows and bad cells by column
   (:class:`Accounting`).

The result is the silver table (:mod:`ledgerlens.sources.silver`), read by every analysis
with pruning and pushdown.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.labels import parse_order_time
from ..session import ensure_checkpoint_dir, ship_package
from . import catalog as C
from .inference import column_states, quoted, resolved


@dataclass(frozen=True)
class Spec:
    """Logical columns to produce: aliases (first present wins) and target types."""
    aliases: dict[str, list[str]]
    types: dict[str, T.DataType] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.aliases)


def transaction_spec() -> Spec:
    return Spec({c: S.ALIASES[c] for c in S.TRANSACTION_COLUMNS},
                {c: S.CANONICAL_TYPES[c] for c in S.TRANSACTION_COLUMNS})


def driver_spec() -> Spec:
    return Spec({c: S.DRIVER_ALIASES[c] for c in S.DRIVER_COLUMNS},
                {c: S.CANONICAL_TYPES[c] for c in S.DRIVER_COLUMNS})


def spec_for(dataset: str) -> Spec:
    return {"reconciled": transaction_spec, "taixe": driver_spec}[dataset]()


def other_names(spec: Spec) -> list[str]:
    """Columns that come from header cells which no alias names."""
    return [c for c in spec.columns if c not in S.CANONICAL_TYPES]


def _position(h: Column, aliases: Sequence[str]) -> Column:
    """1-based position of the first alias present in the header (null if none)."""
    return F.coalesce(*[F.nullif(F.array_position(h, F.lit(a)), F.lit(0)) for a in aliases],
                      F.lit(None).cast("long"))


def _cell(value: Column) -> Column:
    """Null tokens (exact cell values) become null."""
    return F.when(~value.isin(*S.NULL_TOKENS), value)   # a null cell stays null


def _typed(v: Column, dtype: T.DataType | None) -> Column:
    """A cell in its column's type; a bad one is null."""
    if dtype is None or isinstance(dtype, T.StringType):
        return v
    return parse_order_time(v) if isinstance(dtype, T.TimestampNTZType) else v.try_cast(dtype)


def _clean(value: Column, dtype: T.DataType | None) -> Column:
    return _typed(_cell(value), dtype)


def header_positions(headers: DataFrame, spec: Spec, *, h: str = "h", keep: Sequence[str] = ()) -> DataFrame:
    """S8 once per file: for each logical column the 1-based position of its first
    alias present in the header (null when none is).  One small row per file."""
    hc = F.col(h)
    return headers.select(
        "path", *keep, *[_position(hc, aliases).cast("int").alias(f"_pos_{k}")
                         for k, aliases in enumerate(spec.aliases.values())])


def values_at(df: DataFrame, spec: Spec, *, v: str = "v", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: the cell at each resolved position, null tokens removed, typed."""
    vc = F.col(v)
    return df.select(*keep, *[_clean(F.try_element_at(vc, F.col(f"_pos_{k}")), spec.types.get(name)).alias(name)
                              for k, name in enumerate(spec.aliases)])


def resolve_positional(rows: DataFrame, headers: DataFrame, spec: Spec, *,
                       broadcast_headers: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Join positional rows ``(path, v)`` to per-file header positions and pick the cells.

    Alias resolution runs once per file on the header table (one row per file);
    each data row only indexes its array.  The header table is broadcast only
    when the caller knows its row count is bounded (``broadcast_headers=True``);
    otherwise the optimizer decides from its size statistics.
    """
    pos = header_positions(headers, spec)
    pos = F.broadcast(pos) if broadcast_headers else pos
    return values_at(rows.join(pos, "path"), spec, keep=keep)


def with_other_columns(spec: Spec, names: Sequence[str], reserved: Sequence[str]) -> Spec:
    """``spec`` with a column for every header cell of ``names`` that no alias names.

    Only the distinct names reach the driver (they become the schema).  A name that
    clashes with another column, in any case, gets a number.
    """
    known = {a for aliases in spec.aliases.values() for a in aliases}
    aliases, taken = dict(spec.aliases), {c.lower() for c in (*spec.columns, *reserved)}
    for name in sorted(names):
        if name in known:
            continue
        column, k = name, 2
        while column.lower() in taken:
            column, k = f"{name}_{k}", k + 1
        taken.add(column.lower())
        aliases[column] = [name]
    return Spec(aliases, spec.types)


@dataclass
class Accounting:
    """What a load mends, counted by ``DataFrame.observe`` in the pass that reads the rows.

    ``files`` and ``headerless`` (chosen files without an ``ORDER_ID`` cell in a first record) are known once
    the load is planned; :meth:`counts` waits for the first action on the loaded table.
    """
    observation: Observation | None = None
    files: int = 0
    headerless: int = 0
    columns: list[str] = field(default_factory=list)

    def counts(self) -> list[tuple[str, str | None, int]]:
        """``(metric, column, value)``: ``files``, ``headerless_files``, ``rows``, ``ragged_rows`` (more or fewer
        cells than the file's header) and, for each typed column, ``bad_cells``."""
        got = self.observation.get if self.observation is not None else {}
        return [("files", None, self.files), ("headerless_files", None, self.headerless), ("rows", None, got.get("rows", 0)),
                ("ragged_rows", None, got.get("ragged", 0)), *(("bad_cells", c, got.get(f"bad_{k}", 0)) for k, c in enumerate(self.columns))]


#: The text of a record whose cells are not as many as the widest header's.
_RECORD = "_record"


def _cells_of(record: Column, width: int) -> Column:
    """Cells of a record: separators outside quotes, and one."""
    plain = F.regexp_replace(record, '"[^"]*"', "")
    return F.coalesce(F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1, F.lit(width))


def _accounted(rows: DataFrame, spec: Spec, keep: Sequence[str], width: int, accounting: Accounting) -> DataFrame:
    """:func:`values_at` that counts ragged rows and bad cells on the way."""
    names = list(spec.aliases)
    typed = [k for k, n in enumerate(names) if not isinstance(spec.types.get(n, T.StringType()), T.StringType)]
    accounting.columns, accounting.observation = [names[k] for k in typed], Observation()
    raw = rows.select(*keep, (_cells_of(F.col(_RECORD), width) != F.col("_width")).alias("_ragged"),
                      *[_cell(F.try_element_at("v", F.col(f"_pos_{k}"))).alias(f"_raw_{k}") for k in range(len(names))])
    out = raw.select("*", *[_typed(F.col(f"_raw_{k}"), spec.types.get(n)).alias(f"_cell_{k}") for k, n in enumerate(names)])
    seen = out.observe(accounting.observation, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_ragged")).alias("ragged"),
                       *[F.count_if(F.col(f"_raw_{names.index(c)}").isNotNull() & F.col(f"_cell_{names.index(c)}").isNull()).alias(f"bad_{k}")
                         for k, c in enumerate(accounting.columns)])
    return seen.select(*keep, *[F.col(f"_cell_{k}").alias(n) for k, n in enumerate(names)])


def _csv_reader(spark: SparkSession, width: int, *, multi_line: bool = False, with_record: bool = False):
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField(_RECORD, T.StringType())] * with_record)
    # enforceSchema: the positional schema is used as is; the header line of every
    # file (only in the split that starts the file) is dropped
    return (spark.read.schema(schema).option("header", "true").option("enforceSchema", "true")
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("nullValue", "")
            .option("columnNameOfCorruptRecord", _RECORD)
            # quoted cells holding line breaks need multiLine, which reads each file whole
            .option("multiLine", "true" if multi_line else "false"))


def _under(reader, root: str):
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv"), root


def read_positional(spark: SparkSession, root: str | Sequence[str], width: int, *, multi_line: bool = False,
                    with_record: bool = False) -> DataFrame:
    """CSV scan into ``(path, v array<string>)`` without the header lines; ``with_record`` adds the text of
    records that have not ``width`` cells.

    RFC-4180 quoting (``"`` quotes and escapes), one record per line so files
    stay splittable, permissive mode (a malformed line keeps its row).  ``root`` is a
    folder or glob, listed once and recursively, or a list of files.
    """
    reader = _csv_reader(spark, width, multi_line=multi_line, with_record=with_record)
    if isinstance(root, str):
        reader, root = _under(reader, root)
    return reader.csv(root if isinstance(root, str) else list(root)).select(
        F.col("_metadata.file_path").alias("path"), F.array(*[F.col(f"c{i}") for i in range(width)]).alias("v"), *[_RECORD] * with_record)


def _cells(record: Sequence[str]) -> list[str | None]:
    """Header cells, trimmed; a blank one is null."""
    return [c.strip() or None for c in record]


def _first_record(uri: str) -> list[str | None] | None:
    """The first CSV record of a local file that is not blank, whatever its length."""
    path = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")
    with open(path, encoding="utf-8-sig", errors="replace", newline="") as f:
        return next((_cells(r) for r in csv.reader(f) if any(c.strip() for c in r)), None)


def _is_local(root: str) -> bool:
    return "://" not in root.removeprefix("file:///") and (root.startswith("file:/") or ":/" not in root)


def first_line_headers(files: DataFrame) -> DataFrame:
    """``(path, h)`` of local ``files`` (a ``path`` column): one small read per file, in tasks."""
    ship_package(files.sparkSession)

    def read(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "h": [_first_record(p) for p in pdf["path"]]})

    return files.select("path").mapInPandas(read, "path string, h array<string>").where("h is not null")


def scanned_headers(files: DataFrame, root: str | Sequence[str]) -> DataFrame:
    """``(path, h)`` of ``files`` on any file system that Spark reads: the earliest line that is
    not blank in each file's first split, from a pass of the text source."""
    spark = files.sparkSession
    ship_package(spark)
    reader = spark.read
    if isinstance(root, str):
        reader, root = _under(reader, root)
    lines = reader.text(root if isinstance(root, str) else list(root)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line_id"), F.regexp_replace("value", "^\ufeff", "").alias("line"))
    first = (lines.where((F.col("start") == 0) & (F.trim("line") != "")).groupBy("path").agg(F.min_by("line", "line_id").alias("line"))
             .join(files.select("path"), "path", "left_semi"))

    def split(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "h": [_cells(next(csv.reader(io.StringIO(x)))) for x in pdf["line"]]})

    return first.mapInPandas(split, "path string, h array<string>")


def load_files(files: DataFrame, dataset: str, root: str | Sequence[str], *, spec: Spec | None = None,
               header_source: str = "auto", multi_line: bool = False, other_columns: bool = True, infer_types: bool = True,
               accounting: Accounting | None = None) -> DataFrame:
    """Typed rows of ``files`` (a ``path`` column) below ``root``, plus ``biz_date``, ``dataset``,
    ``version``, ``source_file``.

    ``header_source``: ``"first_line"`` (local files), ``"scan"`` (any file system) or
    ``"auto"``.  ``other_columns`` keeps the columns that no alias names, ``infer_types``
    finds their types (else they are strings); ``accounting`` counts what the load mends.
    """
    spark, spec = files.sparkSession, spec or spec_for(dataset)
    meta = ["source_file", "biz_date", "dataset", "version"]
    local = header_source == "first_line" or header_source == "auto" and all(
        _is_local(r) for r in ([root] if isinstance(root, str) else root))
    ensure_checkpoint_dir(spark)
    headers = (first_line_headers(files) if local else scanned_headers(files, root)).checkpoint(eager=True)
    # one pass over the header table: the widest header, the distinct names, the headers that hold the anchor
    found = (headers.select(F.size("h").alias("size"), F.array_contains(F.col("h"), S.HEADER_ANCHOR).cast("int").alias("anchored"),
                            F.posexplode_outer("h").alias("pos", "name"))
             .agg(F.max("size").alias("width"), F.collect_set("name").alias("names"), F.sum(F.when(F.col("pos") == 0, F.col("anchored"))).alias("anchored")).first())
    width = found.width or 1
    if accounting is not None:
        accounting.files = files.count()
        accounting.headerless = accounting.files - (found.anchored or 0)
    if other_columns:
        spec = with_other_columns(spec, found.names, meta)
    data = read_positional(spark, root, width, multi_line=multi_line, with_record=accounting is not None)
    # one row per file: alias positions and the file's catalogue fields
    keep = ["biz_date", "dataset", "version"]
    per_file = header_positions(C.parse_paths(headers.withColumn("_width", F.size("h"))), spec, keep=[*keep, "_width"])
    rows = data.join(per_file, "path")
    others = other_names(spec)
    if infer_types and others:
        spec = Spec(spec.aliases, {**spec.types, **resolved(column_states(values_at(rows, spec), others), others)})
    loaded = values_at(rows, spec, keep=["path", *keep]) if accounting is None else _accounted(rows, spec, ["path", *keep], width, accounting)
    return loaded.select(*map(quoted, spec.columns), F.col("path").alias("source_file"), *keep)


def load_paths(spark: SparkSession, paths: Sequence[str], dataset: str, *, spec: Spec | None = None, root: str | None = None,
               header_source: str = "auto", multi_line: bool = False, other_columns: bool = True, infer_types: bool = True,
               accounting: Accounting | None = None) -> DataFrame:
    """:func:`load_files` for a list of file names."""
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return load_files(files, dataset, root or list(paths), spec=spec, header_source=header_source, multi_line=multi_line,
                      other_columns=other_columns, infer_types=infer_types, accounting=accounting)


def rejected_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files whose header lacks the anchor cell (their rows load with a null id)."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    headers = first_line_headers(listed) if all(map(_is_local, paths)) else scanned_headers(listed, list(paths))
    found = headers.where(F.array_contains("h", S.HEADER_ANCHOR)).select("path")
    return listed.join(found, "path", "left_anti").withColumnRenamed("path", "listed")


def chosen_files(spark: SparkSession, base_path: str, dataset: str, *, date_from=None, date_to=None, days: Sequence | None = None,
                 versions: tuple[int, ...] | None = S.FILE_VERSIONS, listing: DataFrame | None = None) -> DataFrame:
    """The catalogue rows picked for a data set and date range (latest version per day).

    ``listing`` is a ``(path, length)`` frame; by default a ``binaryFile``
    listing of ``base_path`` (no file is opened).
    """
    listing = C.list_files(spark, base_path) if listing is None else listing
    latest = C.latest_versions(C.parse_paths(listing), versions=versions, keep=[c for c in ("modification_time",) if c in listing.columns])
    out = latest.where(F.col("dataset") == dataset)
    if date_from is not None:
        out = out.where(F.col("biz_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        out = out.where(F.col("biz_date") <= F.lit(date_to).cast("date"))
    return out if days is None else out.where(F.col("biz_date").isin(list(days)))


def month_root(base_path: str, date_from, date_to) -> str:
    """A glob over the folders of a date range: its months (``YYYY/MM`` and unpadded ``YYYY/M``),
    or its years where it spans more than four.

    Listing only these folders keeps a one-day load from listing years of drops.  An
    open range lists ``base_path``.
    """
    import datetime as _dt

    if date_from is None or date_to is None:
        return base_path
    lo, hi = (_dt.date.fromisoformat(str(d)[:10]) for d in (date_from, date_to))
    if hi < lo:
        return base_path
    if hi.year - lo.year >= 4:
        alts = [str(y) for y in range(lo.year, hi.year + 1)]
    else:
        alts, y, m = [], lo.year, lo.month
        while (y, m) <= (hi.year, hi.month):
            alts += [f"{y}/{m:02d}"] + [f"{y}/{m}"] * (m < 10)
            y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{base_path.rstrip('/')}/{{{','.join(alts)}}}"


def _empty(spark: SparkSession, spec: Spec) -> DataFrame:
    schema = T.StructType([T.StructField(c, spec.types.get(c, T.StringType())) for c in spec.columns]
                          + [T.StructField("source_file", T.StringType()), T.StructField("biz_date", T.DateType()),
                             T.StructField("dataset", T.StringType()), T.StructField("version", T.IntegerType())])
    return spark.createDataFrame([], schema)


def listed_below(spark: SparkSession, base_path: str, root: str) -> DataFrame | None:
    """The listing of ``root``, a glob below ``base_path``; None if no folder of it exists.  A base folder that
    does not exist is an error, as is any other failure."""
    try:
        return C.list_files(spark, root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    path = spark._jvm.org.apache.hadoop.fs.Path(base_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no base folder {base_path}")
    return None


def load(spark: SparkSession, base_path: str, dataset: str = "reconciled", *, date_from=None, date_to=None, days: Sequence | None = None,
         versions: tuple[int, ...] | None = S.FILE_VERSIONS, multi_line: bool = False, header_source: str = "auto",
         other_columns: bool = True, infer_types: bool = True, accounting: Accounting | None = None) -> DataFrame:
    """Typed table of one data set over any date range (one day or years) or some ``days``.

    Only the folders of the range are listed (:func:`month_root`).  The choice of files is
    a table like any other: no list of names goes through the driver.  A range without
    folders gives an empty table; a base folder that does not exist is an error.
    """
    if days is not None and days:
        date_from, date_to = min(days), max(days)
    root = month_root(base_path, date_from, date_to)
    listing = listed_below(spark, base_path, root)
    if listing is None:
        return _empty(spark, spec_for(dataset))
    files = chosen_files(spark, base_path, dataset, date_from=date_from, date_to=date_to, days=days, versions=versions, listing=listing)
    return load_files(files, dataset, root, multi_line=multi_line, header_source=header_source, other_columns=other_columns,
                      infer_types=infer_types, accounting=accounting)


def write_silver(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write the typed table once as plain Parquet partitioned by ``biz_date``, for a table that
    nobody refreshes (:mod:`ledgerlens.sources.silver` is the one that is).

    Dynamic partition overwrite replaces only the days present in ``df``.  No shuffle: a
    task writes a file for each day it read, and Spark's reader packs several small day
    files into one task.
    """
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("biz_date").parquet(path))


def load_datasets(spark: SparkSession, base_path: str, *, date_from=None, date_to=None,
                  datasets: Sequence[str] = ("reconciled", "taixe"), **kw) -> dict[str, DataFrame]:
    """S7 (both data sets at once): ``{dataset: typed table}`` for one date range."""
    return {ds: load(spark, base_path, ds, date_from=date_from, date_to=date_to, **kw) for ds in datasets}
