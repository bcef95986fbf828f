"""Row selections over a reconciliation table: lookups, drill-downs, one-sided
and mismatching records, ordered samples and pages.

Results are whole by default: a display limit is a keyword (``limit=``) and,
when given, is always applied after a deterministic order on a unique key.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.aggs import ensure, quoted
from ..functions.labels import is_failed


# --------------------------------------------------------------------------- F4
def priority_order(df: DataFrame, priority: Sequence[str] = S.PRIORITY_COLUMNS) -> DataFrame:
    """listed columns first (those present), then the rest in their order."""
    first = [c for c in priority if c in df.columns]
    return df.select(*first, *[quoted(c) for c in df.columns if c not in first])


def important_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F4 (analyzer form): only the listed columns that are present."""
    return df.select(*[c for c in cols if c in df.columns])


def _limited(df: DataFrame, limit: int | None, order_by: Sequence[str]) -> DataFrame:
    if limit is None:
        return df
    return df.orderBy(*order_by).limit(int(limit))


# --------------------------------------------------------------------------- F1
def clean_id_list(ids: DataFrame, column: str | None = None, *, out: str = "order_id") -> DataFrame:
    """Trim ids, drop blanks and repeats (one id per input line)."""
    c = F.col(column or ids.columns[0])
    t = F.trim(c)
    return ids.select(t.alias(out)).where(F.col(out).isNotNull() & (F.col(out) != "")).distinct()


def order_lookup(df: DataFrame, ids: DataFrame | Iterable[str], *, id_col: str = "order_id",
                 ids_col: str | None = None) -> DataFrame:
    """rows whose id is in ``ids`` (a list or a one-column id table).

    A list becomes an ``IN`` predicate (pushed to the scan).  A table is cleaned
    (trim, no blanks) and applied as a left-semi join: the optimizer broadcasts
    it when its measured size is under the threshold, and shuffles both sides
    otherwise - a big id table never goes through the driver.
    """
    df = ensure(df, id_col)
    if isinstance(ids, DataFrame):
        clean = clean_id_list(ids, ids_col, out="_id")
        return df.join(clean, F.col(id_col) == F.col("_id"), "left_semi")
    wanted = sorted({s.strip() for s in ids if s is not None and s.strip()})
    return df.where(F.col(id_col).isin(wanted))


# --------------------------------------------------------------------------- F2, F3
def drillable_statuses(df: DataFrame, *, status_col: str = "reconcile_status",
                       max_rows: int | None = None,
                       exclude: Sequence[str] = (S.STATUS_MATCH,)) -> DataFrame:
    """The drill-down gate: statuses (null included), those with fewer than ``max_rows`` rows if
    the caller gives a gate."""
    df = ensure(df, status_col)
    st = F.col(status_col)
    g = df.groupBy(st.alias("_status")).agg(F.count(F.lit(1)).alias("_rows"))
    cond = F.lit(True)
    if max_rows is not None:
        cond = cond & (F.col("_rows") < F.lit(int(max_rows)))
    if exclude:
        cond = cond & ~F.coalesce(F.col("_status").isin(*exclude), F.lit(False))
    return g.where(cond).select("_status")


def status_drilldown(df: DataFrame, *, status_col: str = "reconcile_status",
                     status: str | None | Sequence = ..., max_rows: int | None = None,
                     exclude: Sequence[str] = (S.STATUS_MATCH,)) -> DataFrame:
    """rows of one status, or of every status but the excluded ones: a filter.

    ``max_rows`` is a gate that only the caller sets: statuses with that many rows or
    more are left out.  The passing statuses, a few words, are a scalar subquery and
    the rows are filtered in place; no row is shuffled.
    """
    df = ensure(df, status_col)
    st = F.col(status_col)
    if status is not ...:
        return priority_order(df.where(st.eqNullSafe(F.lit(status))))
    rows = df.where(~F.coalesce(st.isin(*exclude), F.lit(False))) if exclude else df
    if max_rows is not None:
        gate = drillable_statuses(df, status_col=status_col, max_rows=max_rows, exclude=exclude)
        passing = gate.select(F.struct(F.collect_list("_status").alias("words"),
                                       (F.count_if(F.col("_status").isNull()) > 0).alias("null"))).scalar()
        rows = rows.where(F.coalesce(F.array_contains(passing["words"], st), passing["null"]))
    return priority_order(rows)


def failed_orders(df: DataFrame, *, status_col: str = "merchant_status") -> DataFrame:
    """F2 (failed variant, no gate): rows whose merchant status mentions fail/error."""
    return priority_order(ensure(df, status_col).where(is_failed(status_col)))


def drilldown_filtered(df: DataFrame, *, merchants: DataFrame | Sequence[str] | None = None,
                       services: DataFrame | Sequence[str] | None = None,
                       merchant_col: str = "merchant", service_col: str = "service_type") -> DataFrame:
    """narrow a drill-down by merchant set and raw service set; ``None`` means all."""
    out = ensure(df, merchant_col, service_col)
    for values, col in ((merchants, merchant_col), (services, service_col)):
        if values is None:
            continue
        if isinstance(values, DataFrame):
            key = values.select(F.col(values.columns[0]).alias("_v")).distinct()
            out = out.join(key, F.col(col) == F.col("_v"), "left_semi")
        else:
            out = out.where(F.col(col).isin(list(values)))
    return out


# --------------------------------------------------------------------------- F5
DISCREPANCY_COLUMNS = ["order_id", "merchant", "amount", "order_time", "reconcile_status"]


def one_sided(df: DataFrame, side: str, *, status_col: str = "reconcile_status",
              limit: int | None = None, order_by: Sequence[str] = ("order_id",),
              columns: Sequence[str] = DISCREPANCY_COLUMNS) -> DataFrame:
    """records present on one side only (status *contains* the side's word).

    ``side='m'``: insurer-only (``not_found_in_m``); ``side='external'``:
    platform-only (``not_found_in_external``).
    """
    word = {"m": S.STATUS_ONLY_M, "external": S.STATUS_ONLY_EXTERNAL}[side]
    rows = important_columns(ensure(df, status_col).where(F.col(status_col).contains(word)), columns)
    return _limited(rows, limit, order_by)


# --------------------------------------------------------------------------- F6, F7
def _with_diff(df: DataFrame, left: str, right: str) -> DataFrame:
    lc, rc = F.col(left), F.col(right)
    return ensure(df, "order_id", "merchant").select(
        "order_id", "merchant", lc.cast("double").alias(left), rc.cast("double").alias(right),
        (lc - rc).cast("double").alias("amount_diff"),
        (F.try_divide((lc - rc).cast("double"), rc.cast("double")) * F.lit(100.0)).alias("diff_percentage"))


def amount_mismatch(df: DataFrame, *, left: str = "gsm_amount", right: str = "merchant_amount",
                    limit: int | None = None, order_by: Sequence[str] = ("order_id",)) -> DataFrame:
    """both amounts present and unequal; adds difference and percent difference.

    The percent difference is null when the right amount is 0.
    """
    lc, rc = F.col(left), F.col(right)
    rows = ensure(df, left, right).where(lc.isNotNull() & rc.isNotNull() & (lc != rc))
    return _limited(_with_diff(rows, left, right), limit, order_by)


def high_amount_discrepancy(df: DataFrame, *, left: str = "gsm_amount", right: str = "merchant_amount",
                            ratio: float = S.HIGH_DISCREPANCY_RATIO, limit: int | None = None,
                            order_by: Sequence[str] = ("order_id",)) -> DataFrame:
    """right amount > 0 and |left - right| / right > ``ratio`` (strict).

    Tested as ``|left - right| > ratio * right`` in exact decimal arithmetic, so
    the border (exactly 10 %) is not flaky.
    """
    rows = ensure(df, left, right).where(high_discrepancy(left, right, ratio))
    return _limited(_with_diff(rows, left, right), limit, order_by)


def high_discrepancy(left: str = "gsm_amount", right: str = "merchant_amount",
                     ratio: float = S.HIGH_DISCREPANCY_RATIO):
    """The F7 predicate: both present, right > 0, |left - right| > ratio * right.

    Kept as plain conjuncts so the not-null and range parts reach the Parquet scan.
    """
    lc, rc = F.col(left), F.col(right)
    thr = F.lit(str(ratio)).cast("decimal(10,6)")
    return lc.isNotNull() & rc.isNotNull() & (rc > 0) & (F.abs(lc - rc) > rc * thr)


# --------------------------------------------------------------------------- L2, L3
def sample_head(df: DataFrame, n: int = 100, *, order_by: Sequence[str] = ("order_id",)) -> DataFrame:
    """L2: the first ``n`` rows in key order (a per-partition top-n, then one merge of n rows/partition)."""
    return priority_order(df.orderBy(*order_by).limit(int(n)))


def page_count(df: DataFrame, size: int) -> DataFrame:
    """L3: rows and pages = ceil(rows / size)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "page_count", F.ceil(F.col("row_count") / F.lit(int(size))).cast("bigint"))


def page_rows(df: DataFrame, page: int, size: int, *, order_by: Sequence[str] = ("order_id",)) -> DataFrame:
    """L3: page ``page`` (0-based) of ``size`` rows in key order.

    For the first pages: it plans as a top-(page+1)*size of each partition plus an
    offset, so its cost grows with the page number.  A reader that goes deep must use
    :func:`page_after` (keyset paging), whose cost does not.
    """
    return priority_order(df.orderBy(*order_by).offset(int(page) * int(size)).limit(int(size)))


def page_after(df: DataFrame, last_key: str | None, size: int, *, key: str = "order_id") -> DataFrame:
    """L3 (keyset form): the ``size`` rows that follow ``last_key``; a pushed-down range filter."""
    rows = df if last_key is None else df.where(F.col(key) > F.lit(last_key))
    return priority_order(rows.orderBy(key).limit(int(size)))
