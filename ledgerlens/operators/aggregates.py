"""Aggregations over a reconciliation table (DataFrame in, small DataFrame out).

Every operator is one ``groupBy``/``agg`` (partial aggregation before the
shuffle, so a hot merchant or status costs no more than any other key) and
takes an optional ``by`` list, e.g. ``by=["biz_date"]``, to answer per day over
any number of days at once.  Column names and thresholds are keyword
arguments; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import labels as L
from ..functions.aggs import ensure, keys, mean_of, money_sum, quoted, ratio_pct, unique_counts, whole, with_share

DEFAULT_AMOUNT_COLUMNS = ("gsm_amount", "merchant_amount", "reconciled_amount", "amount")

# Sums of money columns, widened so the sums of several columns share one type.
WIDE_MONEY = "decimal(38,2)"


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that ``df`` has; without any, the first one (a null column)."""
    have = set(df.columns)
    return [c for c in cols if c in have] or list(cols[:1])


def _desc_count(df: DataFrame, count_col: str, *tie: str) -> DataFrame:
    """L1: order by count descending with a deterministic tie-break."""
    return df.orderBy(F.desc(count_col), *[F.asc_nulls_first(t) for t in tie])


# --------------------------------------------------------------------------- A1, A3
def value_distribution(df: DataFrame, column: str, *, by: Sequence[str] | None = None,
                       label: Column | None = None, out: str | None = None,
                       count_col: str = "order_count") -> DataFrame:
    """Count per value (or per label of the value) with its share of all rows."""
    by = keys(by)
    df = ensure(df, column)
    name = out or column
    key = (label if label is not None else F.col(column)).alias(name)
    grouped = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias(count_col))
    return distribution_of(grouped, name, by, count_col=count_col)


def distribution_of(grouped: DataFrame, name: str, by: Sequence[str] | None = None, *, count_col: str = "order_count") -> DataFrame:
    """Counts per value with their shares, largest first."""
    by = keys(by)
    return _desc_count(with_share(grouped, count_col, by), count_col, *by, name)


def reconcile_status_distribution(df: DataFrame, *, status_col: str = "reconcile_status",
                                  by: Sequence[str] | None = None) -> DataFrame:
    """A1: rows per reconcile status, share of all rows, reconcile class."""
    out = value_distribution(df, status_col, by=by)
    return out.withColumn("reconcile_class", L.reconcile_class(status_col))


def insurance_distribution(df: DataFrame, *, status_col: str = "insurance_status",
                           by: Sequence[str] | None = None) -> DataFrame:
    """A3: rows per insurance status with share."""
    return value_distribution(df, status_col, by=by)


# --------------------------------------------------------------------------- A2
def _descriptions() -> Column:
    pairs = []
    for k, v in S.STATUS_DESCRIPTIONS:
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def reconcile_status_summary(df: DataFrame, *, status_col: str = "reconcile_status",
                             amount_col: str = "amount", by: Sequence[str] | None = None) -> DataFrame:
    """A2 (flagship): count, amount sum and mean, description and share per status.

    A missing sum or mean (no amount values) is reported as 0.  The description
    is a literal map lookup (F13) that stays inside generated code; unknown
    statuses describe themselves.
    """
    by = keys(by)
    df = ensure(df, status_col, amount_col)
    amt = F.col(amount_col)
    grouped = df.groupBy(*by, F.col(status_col).alias("reconcile_status")).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(amt).alias("_sum"),
        F.count(amt).alias("_n"))
    return status_summary_of(grouped, by)


def status_summary_of(grouped: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """A2 from ``(reconcile_status, order_count, _sum, _n)``."""
    by, st = keys(by), F.col("reconcile_status")
    out = with_share(grouped, "order_count", by).select(
        *by, st,
        L.reconcile_class(st).alias("reconcile_class"),
        F.coalesce(F.try_element_at(_descriptions(), st), st).alias("description"),
        "order_count",
        F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(mean_of("_sum", "_n"), F.lit(0.0)).alias("avg_amount"),
        "percent")
    return _desc_count(out, "order_count", *by, "reconcile_status")


# --------------------------------------------------------------------------- A4, F9
def business_distribution(df: DataFrame, *, column: str = "is_business_order",
                          by: Sequence[str] | None = None) -> DataFrame:
    """A4: rows per business label (raw spellings of one label add up, D2)."""
    return value_distribution(df, column, by=by, label=L.business_label(column), out="business_label")


def business_rate(df: DataFrame, *, column: str = "is_business_order",
                  by: Sequence[str] | None = None) -> DataFrame:
    """A4: total rows, business rows and business rate (percent)."""
    by = keys(by)
    out = ensure(df, column).groupBy(*by).agg(F.count(F.lit(1)).alias("total_orders"),
                              F.count_if(L.is_business(column)).alias("business_orders"))
    return out.withColumn("business_rate", ratio_pct("business_orders", "total_orders"))


# --------------------------------------------------------------------------- A5, F8
def service_type_distribution(df: DataFrame, *, column: str = "service_type",
                              by: Sequence[str] | None = None) -> DataFrame:
    """A5: rows per service label (``normal``/``Normal`` add up, D1; null is unknown, D10)."""
    return value_distribution(df, column, by=by, label=L.service_label(column), out="service_label")


def service_type_summary(df: DataFrame, *, column: str = "service_type",
                         by: Sequence[str] | None = None) -> DataFrame:
    """A5: ride / express / unknown counts and the total in one row."""
    by = keys(by)
    lab = F.lower(L.service_label(column))
    return ensure(df, column).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(lab.contains("ride")).alias("ride_orders"),
        F.count_if(lab.contains("express")).alias("express_orders"),
        F.count_if(lab == S.SERVICE_UNKNOWN_LABEL.lower()).alias("unknown_orders"))


# --------------------------------------------------------------------------- A6, A7
def _stack(per_col: dict[str, list[Column]], names: list[str]) -> Column:
    """``stack`` expression turning k groups of measures into k rows."""
    args = []
    for col_name, measures in per_col.items():
        args.append(F.lit(col_name))
        args.extend(measures)
    return F.stack(F.lit(len(per_col)), *args).alias("amount_type", *names)


def amount_by_service(df: DataFrame, *, amount_cols: Sequence[str] = DEFAULT_AMOUNT_COLUMNS,
                      service_col: str = "service_type", by: Sequence[str] | None = None) -> DataFrame:
    """Per amount column and service label: total, non-null count, mean, rows, share.

    One scan and one shuffle for all amount columns (the measures of every
    column are computed in the same aggregate, then stacked into rows).
    """
    by = keys(by)
    cols = _present(df, amount_cols)
    df = ensure(df, service_col, *cols)
    aggs = []
    for c in cols:
        aggs += [F.sum(c).alias(f"{c}__sum"), F.count(c).alias(f"{c}__n")]
    grouped = df.groupBy(*by, L.service_label(service_col).alias("service_label")).agg(
        F.count(F.lit(1)).alias("row_count"), *aggs)
    return amounts_by_service_of(grouped, cols, by)


def amounts_by_service_of(grouped: DataFrame, cols: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """A6 from ``(service_label, row_count, <column>__sum, <column>__n, ...)``."""
    by = keys(by)
    # exact decimal sums go through the stack
    per_col = {c: [F.col(f"{c}__sum").cast(WIDE_MONEY), F.col(f"{c}__n")] for c in cols}
    long = grouped.select(*by, "service_label", "row_count", _stack(per_col, ["_sum", "amount_count"]))
    total = F.coalesce(F.col("_sum").cast("double"), F.lit(0.0))
    if by:
        # one total per (day, amount type): a window partitioned by those keys
        col_total = F.sum("_sum").over(Window.partitionBy(*by, "amount_type"))
    else:
        # the column totals of the whole table, from the grouped rows
        totals = whole(grouped, F.struct(*[F.sum(f"{c}__sum").cast(WIDE_MONEY).alias(c) for c in cols]))
        col_total = None
        for c in cols:
            col_total = (F.when(F.col("amount_type") == c, totals.getField(c)) if col_total is None
                         else col_total.when(F.col("amount_type") == c, totals.getField(c)))
    return long.select(
        *by, "amount_type", "service_label",
        total.alias("total_amount"),
        "amount_count",
        F.coalesce(mean_of("_sum", "amount_count"), F.lit(0.0)).alias("avg_amount"),
        "row_count",
        ratio_pct(total, col_total).alias("percent_of_total"),
    ).orderBy(*by, "amount_type", F.desc("total_amount"), "service_label")


def amount_overall(df: DataFrame, *, amount_cols: Sequence[str] = DEFAULT_AMOUNT_COLUMNS,
                   by: Sequence[str] | None = None) -> DataFrame:
    """Per amount column: total, non-null count and overall mean = total / count."""
    by = keys(by)
    cols = _present(df, amount_cols)
    aggs = []
    for c in cols:
        aggs += [F.sum(c).alias(f"{c}__sum"), F.count(c).alias(f"{c}__n")]
    return amounts_of(ensure(df, *cols).groupBy(*by).agg(*aggs), cols, by)


def amounts_of(one: DataFrame, cols: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """A6, overall, from ``(<column>__sum, <column>__n, ...)``."""
    by = keys(by)
    per_col = {c: [F.col(f"{c}__sum").cast(WIDE_MONEY), F.col(f"{c}__n")] for c in cols}
    long = one.select(*by, _stack(per_col, ["_sum", "amount_count"]))
    return long.select(*by, "amount_type",
                       F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("total_amount"),
                       "amount_count",
                       F.coalesce(mean_of("_sum", "amount_count"), F.lit(0.0)).alias("avg_amount"))


def amount_comparison_matrix(df: DataFrame, *, amount_cols: Sequence[str] = DEFAULT_AMOUNT_COLUMNS,
                             service_col: str = "service_type", by: Sequence[str] | None = None) -> DataFrame:
    """Service label x amount column totals; a missing total is 0."""
    by = keys(by)
    cols = _present(df, amount_cols)
    return (ensure(df, service_col, *cols).groupBy(*by, L.service_label(service_col).alias("service_label"))
            .agg(*[F.coalesce(money_sum(c), F.lit(0.0)).alias(f"{c}_total") for c in cols])
            .orderBy(*by, "service_label"))


# --------------------------------------------------------------------------- A8, A17
def merchant_patterns(df: DataFrame, *, merchant_col: str = "merchant", status_col: str = "reconcile_status",
                      amount_col: str = "amount", by: Sequence[str] | None = None,
                      sort: bool = True) -> DataFrame:
    """Per merchant: transactions, amount total/mean, match and discrepancy counts and rates.

    ``match`` is an equality test, ``discrepancy`` a substring test for
    ``not_found`` (both as in the source semantics, D17).  One row per merchant:
    the result grows with the number of merchants, so it is sorted by a
    distributed range sort only when ``sort`` is set.
    """
    by = keys(by)
    df = ensure(df, merchant_col, status_col, amount_col)
    st = F.col(status_col)
    grouped = df.groupBy(*by, F.col(merchant_col).alias("merchant")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(amount_col).alias("_sum"), F.count(amount_col).alias("_n"),
        F.count_if(st == S.STATUS_MATCH).alias("match_count"),
        F.count_if(L.contains_flag(st, S.STATUS_NOT_FOUND)).alias("discrepancy_count"))
    return merchants_of(grouped, by, sort=sort)


def merchants_of(grouped: DataFrame, by: Sequence[str] | None = None, *, sort: bool = True) -> DataFrame:
    """A8 from ``(merchant, total_transactions, _sum, _n, match_count, discrepancy_count)``."""
    by = keys(by)
    out = grouped.select(
        *by, "merchant", "total_transactions", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("total_amount"),
        mean_of("_sum", "_n").alias("avg_amount"), "match_count", "discrepancy_count",
        ratio_pct("match_count", "total_transactions").alias("match_rate"),
        ratio_pct("discrepancy_count", "total_transactions").alias("discrepancy_rate"))
    return _desc_count(out, "total_transactions", *by, "merchant") if sort else out


def unusual_merchants(patterns: DataFrame, *, rate_threshold: float = S.UNUSUAL_MERCHANT_RATE) -> DataFrame:
    """Merchants whose discrepancy rate is above ``rate_threshold`` percent."""
    return patterns.where(F.col("discrepancy_rate") > F.lit(float(rate_threshold)))


# --------------------------------------------------------------------------- A9, L4
def hourly_patterns(df: DataFrame, *, time_col: str = "order_time", status_col: str = "reconcile_status",
                    by: Sequence[str] | None = None, sort: bool = True) -> DataFrame:
    """Per hour of the order time: transactions, matches, match rate.

    An unparseable time does not void the analysis (D9): such rows form the
    ``hour = null`` group.
    """
    by = keys(by)
    df = ensure(df, time_col, status_col)
    hour = F.hour(L.order_time(df, time_col)).cast("int").alias("hour")
    out = (df.groupBy(*by, hour)
           .agg(F.count(F.lit(1)).alias("transaction_count"),
                F.count_if(F.col(status_col) == S.STATUS_MATCH).alias("match_count"))
           .withColumn("match_rate", ratio_pct("match_count", "transaction_count")))
    return out.orderBy(*by, F.asc_nulls_last("hour")) if sort else out


def peak_hour(hourly: DataFrame, *, by: Sequence[str] | None = None) -> DataFrame:
    """L4: the busiest parsed hour (ties -> the earlier hour); one row per ``by`` group."""
    by = keys(by)
    valid = hourly.where(F.col("hour").isNotNull())
    best = F.max_by(F.struct("hour", "transaction_count", "match_count", "match_rate"),
                    F.struct(F.col("transaction_count"), -F.col("hour")))
    return valid.groupBy(*by).agg(best.alias("p")).select(*by, "p.*")


# --------------------------------------------------------------------------- A10
def summary_stats(df: DataFrame, *, id_col: str = "order_id", merchant_col: str = "merchant",
                  time_col: str = "order_time", by: Sequence[str] | None = None) -> DataFrame:
    """A10: rows, distinct orders and merchants (null is a value), time range, duplicate share."""
    by = keys(by)
    df = ensure(df, id_col, merchant_col, time_col)
    ts = L.order_time(df, time_col)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(ts).alias("min_order_time"),
        F.max(ts).alias("max_order_time"))
    out = unique_counts(df, by, {"unique_orders": id_col, "unique_merchants": merchant_col}, base).select(
        *by, "total_records", "unique_orders", "unique_merchants", "min_order_time", "max_order_time")
    dup = F.try_divide((F.col("total_records") - F.col("unique_orders")).cast("double") * F.lit(100.0),
                       F.greatest(F.col("total_records"), F.lit(1)).cast("double"))
    return out.withColumn("duplicate_percent", dup)


# --------------------------------------------------------------------------- A11
def drilldown_kpis(df: DataFrame, *, status_col: str = "reconcile_status", id_col: str = "order_id",
                   merchant_col: str = "merchant", amount_col: str = "amount",
                   service_col: str = "service_type", by: Sequence[str] | None = None) -> DataFrame:
    """Per status at once: rows, distinct orders, merchants, service types, amount."""
    by = [*keys(by), "reconcile_status"]
    df = ensure(df, status_col, id_col, merchant_col, amount_col, service_col)
    df = df if status_col == "reconcile_status" else df.withColumn("reconcile_status", F.col(status_col))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(money_sum(amount_col), F.lit(0.0)).alias("total_amount"))
    return unique_counts(df, by, {"unique_orders": id_col, "unique_merchants": merchant_col, "service_types": service_col},
                         base).select(*by, "row_count", "unique_orders", "unique_merchants", "total_amount", "service_types")


# --------------------------------------------------------------------------- A12, A13
def vehicle_distribution(df: DataFrame, *, amount_col: str = "gsm_amount",
                         by: Sequence[str] | None = None) -> DataFrame:
    """Bike / Car / other rows by platform amount, with share (null -> other)."""
    return value_distribution(df, amount_col, by=by, label=L.vehicle_class(amount_col), out="vehicle")


def vehicle_amount_comparison(df: DataFrame, *, left: str = "gsm_amount", right: str = "merchant_amount",
                              by: Sequence[str] | None = None) -> DataFrame:
    """Platform vs merchant totals and counts for Bike, Car and their total.

    Each side is classed by its own amount.  One conditional aggregate (one scan,
    partial aggregation only) gives all eight numbers; ``stack`` shapes the rows.
    """
    by = keys(by)
    df = ensure(df, left, right)
    lc, rc = F.col(left), F.col(right)
    bike, car = S.VEHICLE_BIKE_AMOUNT, S.VEHICLE_CAR_AMOUNT
    one = df.groupBy(*by).agg(
        F.sum(F.when(lc == bike, lc)).alias("lb"), F.sum(F.when(lc == car, lc)).alias("lc"),
        F.sum(F.when(rc == bike, rc)).alias("rb"), F.sum(F.when(rc == car, rc)).alias("rc"),
        F.count_if(lc == bike).alias("nlb"), F.count_if(lc == car).alias("nlc"),
        F.count_if(rc == bike).alias("nrb"), F.count_if(rc == car).alias("nrc"))
    return vehicle_amounts_of(one, left, right, by)


def vehicle_amounts_of(one: DataFrame, left: str, right: str, by: Sequence[str] | None = None) -> DataFrame:
    """A13 from the sums ``lb, lc, rb, rc`` (left and right, Bike and Car) and counts ``nlb, nlc, nrb, nrc``."""
    by = keys(by)
    z = F.lit(0).cast(WIDE_MONEY)
    lb, lcar, rb, rcar = (F.coalesce(F.col(x).cast(WIDE_MONEY), z) for x in ("lb", "lc", "rb", "rc"))
    rows = F.stack(F.lit(3),
                   F.lit(S.VEHICLE_BIKE), lb, rb, F.col("nlb"), F.col("nrb"),
                   F.lit(S.VEHICLE_CAR), lcar, rcar, F.col("nlc"), F.col("nrc"),
                   F.lit("Total"), (lb + lcar).cast(WIDE_MONEY), (rb + rcar).cast(WIDE_MONEY),
                   F.col("nlb") + F.col("nlc"), F.col("nrb") + F.col("nrc"),
                   ).alias("vehicle", "_l", "_r", f"{left}_count", f"{right}_count")
    return one.select(*by, rows).select(
        *by, "vehicle",
        F.col("_l").cast("double").alias(f"{left}_total"),
        F.col("_r").cast("double").alias(f"{right}_total"),
        (F.col("_l") + F.col("_r")).cast("double").alias("total_amount"),
        f"{left}_count", f"{right}_count")


# --------------------------------------------------------------------------- A14, A15
def merchant_status_distribution(df: DataFrame, *, status_col: str = "merchant_status",
                                 by: Sequence[str] | None = None) -> DataFrame:
    """Rows per merchant status, share and severity (bad / good / neutral)."""
    return value_distribution(df, status_col, by=by).withColumn("severity", L.severity(status_col))


def failed_rollup(df: DataFrame, *, status_col: str = "merchant_status",
                  by: Sequence[str] | None = None) -> DataFrame:
    """Failed rows (status mentions fail/error), their share and the rest."""
    by = keys(by)
    out = ensure(df, status_col).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(L.is_failed(status_col)).alias("failed_orders"),
        F.count_distinct(F.when(L.is_failed(status_col), F.col(status_col))).alias("failed_statuses"))
    return failures_of(out, by)


def failures_of(out: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """A15 from ``(total_orders, failed_orders, failed_statuses)``."""
    by = keys(by)
    return out.select(*by, "total_orders", "failed_orders", "failed_statuses",
                      ratio_pct("failed_orders", "total_orders").alias("failed_percent"),
                      (F.col("total_orders") - F.col("failed_orders")).alias("successful_orders"))


# --------------------------------------------------------------------------- A16
def duplicate_orders(df: DataFrame, *, id_col: str = "order_id", by: Sequence[str] | None = None) -> DataFrame:
    """Ids seen more than once, with their count.

    The partial aggregate collapses copies inside each input split before the
    shuffle, so one id holding a third of all rows still ships one row per split.
    """
    by = keys(by)
    return (ensure(df, id_col).groupBy(*by, F.col(id_col).alias("order_id"))
            .agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1))


# --------------------------------------------------------------------------- A18
def column_profile(df: DataFrame, *, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, null count and null share, from one aggregate (one scan)."""
    cols = list(columns) if columns else df.columns
    types = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(quoted(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    args = []
    for i, c in enumerate(cols):
        args += [F.lit(c), F.lit(types[c]), F.col(f"_n{i}")]
    long = one.select("_rows", F.stack(F.lit(len(cols)), *args).alias("column_name", "data_type", "null_count"))
    return long.select("column_name", "data_type", "null_count",
                       ratio_pct("null_count", "_rows").alias("null_percent"),
                       F.col("_rows").alias("row_count"))
