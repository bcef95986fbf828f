"""A1-A9, A12-A15 over any range of days, from a table of mergeable daily partials; day-over-day trends.

:func:`daily_partials` is one row for each day, dimension and value, with counts and exact sums:
one scan, one aggregate.  Counts and sums merge by addition, so any range of days is a sum over few rows
(:class:`Partials`), and every result equals the full scan's.

Beside a silver table (:mod:`ledgerlens.sources.silver`), :func:`refresh_partials` keeps them
by generation, written once like the rows: a refresh costs the days it touches, and readers join
the table's state, so rows and partials never disagree.  Dimensions are a fixed list; the one
that grows is the merchant, by at most a row a merchant and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import labels as L
from ..functions.aggs import ensure, ratio_pct
from ..sources import csv_ingest as I
from ..sources import silver as V
from . import aggregates as A

AMOUNTS = ("amount", "gsm_amount", "merchant_amount", "reconciled_amount")
MEASURES = ("rows", "match_rows", "not_found_rows", *(f"{c}__{x}" for c in AMOUNTS for x in ("sum", "n")))


def daily_partials(df: DataFrame, *, day: str = "biz_date") -> DataFrame:
    """``(biz_date, dimension, value, rows, match_rows, not_found_rows, <amount>__sum, <amount>__n, ...)``.

    Dimensions: the statuses, labels, merchant and hour of A1-A9 and A14, the vehicle class of A12, and for
    A13 the vehicle class of each amount.  A null value is a value.
    """
    df = ensure(df, "reconcile_status", "insurance_status", "is_business_order", "service_type", "merchant", "order_time", "merchant_status", *AMOUNTS)
    status = F.col("reconcile_status")
    dimensions = {
        "reconcile_status": status, "insurance_status": F.col("insurance_status"), "business_label": L.business_label("is_business_order"),
        "service_label": L.service_label("service_type"), "merchant": F.col("merchant"), "merchant_status": F.col("merchant_status"),
        "hour": F.hour(L.order_time(df, "order_time")).cast("string"), "vehicle": L.vehicle_class("gsm_amount"),
        "gsm_amount_class": L.vehicle_class("gsm_amount"), "merchant_amount_class": L.vehicle_class("merchant_amount")}
    slim = df.select(F.col(day).alias("biz_date"), (status == S.STATUS_MATCH).alias("_match"), L.contains_flag(status, S.STATUS_NOT_FOUND).alias("_lost"),
                     *AMOUNTS, F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in dimensions.items()])))
    sums = [x for c in AMOUNTS for x in (F.sum(c).cast(A.WIDE_MONEY).alias(f"{c}__sum"), F.count(c).alias(f"{c}__n"))]
    return slim.groupBy("biz_date", "dimension", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_match").alias("match_rows"), F.count_if("_lost").alias("not_found_rows"), *sums)


class Partials:
    """The analyses over a range of days of a table of daily partials."""

    def __init__(self, daily: DataFrame, date_from=None, date_to=None):
        for given, keep in ((date_from, lambda x: F.col("biz_date") >= F.lit(x).cast("date")), (date_to, lambda x: F.col("biz_date") <= F.lit(x).cast("date"))):
            daily = daily if given is None else daily.where(keep(given))
        self.daily = daily

    def _of(self, dimension: str, name: str, by: Sequence[str] = ()) -> DataFrame:
        """``(*by, name, <measures>)``: one dimension, added up over the days."""
        measures = [F.sum(F.col(m)).alias(m) for m in MEASURES]
        return self.daily.where(F.col("dimension") == dimension).groupBy(*by, F.col("value").alias(name)).agg(*measures)

    def _distribution(self, dimension: str, name: str | None = None, by: Sequence[str] = ()) -> DataFrame:
        name = name or dimension
        return A.distribution_of(self._of(dimension, name, by).select(*by, name, F.col("rows").alias("order_count")), name, by)

    def reconcile_status_distribution(self, by: Sequence[str] = ()) -> DataFrame:
        return self._distribution("reconcile_status", by=by).withColumn("reconcile_class", L.reconcile_class("reconcile_status"))

    def reconcile_status_summary(self, by: Sequence[str] = ()) -> DataFrame:
        found = self._of("reconcile_status", "reconcile_status", by)
        return A.status_summary_of(found.select(*by, "reconcile_status", F.col("rows").alias("order_count"), F.col("amount__sum").alias("_sum"),
                                                F.col("amount__n").alias("_n")), by)

    def insurance_distribution(self) -> DataFrame:
        return self._distribution("insurance_status")

    def business_distribution(self) -> DataFrame:
        return self._distribution("business_label")

    def business_rate(self) -> DataFrame:
        rows = self._of("business_label", "business_label")
        return (rows.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("total_orders"),
                         F.coalesce(F.sum(F.when(F.col("business_label") == S.BUSINESS_LABEL, F.col("rows"))), F.lit(0).cast("long")).alias("business_orders"))
                .withColumn("business_rate", ratio_pct("business_orders", "total_orders")))

    def service_type_distribution(self) -> DataFrame:
        return self._distribution("service_label")

    def amount_by_service(self, amounts: Sequence[str] = AMOUNTS) -> DataFrame:
        found = self._of("service_label", "service_label")
        return A.amounts_by_service_of(found.select("service_label", F.col("rows").alias("row_count"), *self._measures(amounts)), amounts)

    def amount_overall(self, amounts: Sequence[str] = AMOUNTS) -> DataFrame:
        rows = self.daily.where("dimension = 'service_label'")
        none = F.lit(0).cast("long")
        one = rows.agg(*[F.sum(f"{c}__sum").alias(f"{c}__sum") for c in amounts], *[F.coalesce(F.sum(f"{c}__n"), none).alias(f"{c}__n") for c in amounts])
        return A.amounts_of(one, amounts)

    def amount_comparison_matrix(self, amounts: Sequence[str] = AMOUNTS) -> DataFrame:
        total = lambda c: F.coalesce(F.col(f"{c}__sum").cast("double"), F.lit(0.0)).alias(f"{c}_total")
        return self._of("service_label", "service_label").select("service_label", *map(total, amounts)).orderBy("service_label")

    def merchant_patterns(self, by: Sequence[str] = (), *, sort: bool = True) -> DataFrame:
        found = self._of("merchant", "merchant", by)
        return A.merchants_of(found.select(*by, "merchant", F.col("rows").alias("total_transactions"), F.col("amount__sum").alias("_sum"),
                                           F.col("amount__n").alias("_n"), F.col("match_rows").alias("match_count"),
                                           F.col("not_found_rows").alias("discrepancy_count")), by, sort=sort)

    def hourly_patterns(self) -> DataFrame:
        found = self._of("hour", "_hour").select(F.col("_hour").cast("int").alias("hour"), F.col("rows").alias("transaction_count"),
                                                 F.col("match_rows").alias("match_count"))
        return found.withColumn("match_rate", ratio_pct("match_count", "transaction_count")).orderBy(F.asc_nulls_last("hour"))

    def vehicle_distribution(self) -> DataFrame:
        return self._distribution("vehicle")

    def vehicle_amount_comparison(self, left: str = "gsm_amount", right: str = "merchant_amount") -> DataFrame:
        pick = []
        for column, side in ((left, "l"), (right, "r")):
            for vehicle, letter in ((S.VEHICLE_BIKE, "b"), (S.VEHICLE_CAR, "c")):
                here = (F.col("dimension") == f"{column}_class") & (F.col("value") == vehicle)
                pick += [F.sum(F.when(here, F.col(f"{column}__sum"))).alias(side + letter),
                         F.coalesce(F.sum(F.when(here, F.col(f"{column}__n"))), F.lit(0).cast("long")).alias(f"n{side}{letter}")]
        one = self.daily.where(F.col("dimension").isin(f"{left}_class", f"{right}_class")).agg(*pick)
        return A.vehicle_amounts_of(one, left, right)

    def merchant_status_distribution(self) -> DataFrame:
        return self._distribution("merchant_status").withColumn("severity", L.severity("merchant_status"))

    def failed_rollup(self) -> DataFrame:
        rows, zero = self._of("merchant_status", "merchant_status"), F.lit(0).cast("long")
        return A.failures_of(rows.agg(F.coalesce(F.sum("rows"), zero).alias("total_orders"),
                                      F.coalesce(F.sum(F.when(L.is_failed("merchant_status"), F.col("rows"))), zero).alias("failed_orders"),
                                      F.count_if(L.is_failed("merchant_status")).alias("failed_statuses")))

    def _measures(self, amounts: Sequence[str]) -> list[str]:
        return [f"{c}__{x}" for c in amounts for x in ("sum", "n")]


# --------------------------------------------------------------------------- X2
def dense_days(values: DataFrame, *, day: str = "biz_date") -> DataFrame:
    """``(day, value, ...)``: every value on every day from the first to the last day of all."""
    ends = values.agg(F.struct(F.min(day).alias("low"), F.max(day).alias("high")).alias("ends")).scalar()
    names = [c for c in values.columns if c != day]
    return values.select(*names).distinct().select(F.explode(F.sequence(ends["low"], ends["high"])).alias(day), *names)


def day_over_day(daily: DataFrame, dimension: str = "reconcile_status", *, measure: str = "rows") -> DataFrame:
    """``(biz_date, value, <measure>, has_day, previous, change, change_percent)`` of a dimension's values, on a
    calendar without gaps.

    A day without rows counts 0 for every value; ``has_day`` tells whether the table has the day.  ``previous`` is
    the day before, null on the first; the percentage is null where that was 0.
    """
    counts = daily.where(F.col("dimension") == dimension).select("biz_date", F.col("value"), F.col(measure).alias("_m"))
    calendar = dense_days(counts.select("biz_date", "value"))
    days = counts.select(F.col("biz_date").alias("_day")).distinct()
    same = (calendar["biz_date"] == F.col("_there")) & calendar["value"].eqNullSafe(F.col("_value"))
    found = (calendar.join(counts.select(F.col("biz_date").alias("_there"), F.col("value").alias("_value"), "_m"), same, "left")
             .join(days, calendar["biz_date"] == F.col("_day"), "left")
             .select(calendar["biz_date"], calendar["value"], F.coalesce("_m", F.lit(0)).alias(measure), F.col("_day").isNotNull().alias("has_day")))
    before = F.lag(measure).over(Window.partitionBy("value").orderBy("biz_date"))
    return found.withColumn("previous", before).withColumns({
        "change": F.col(measure) - F.col("previous"), "change_percent": ratio_pct(F.col(measure) - F.col("previous"), "previous")})


# --------------------------------------------------------------------------- beside a silver table
def _folder(silver_path: str, generation: int) -> str:
    return f"{silver_path.rstrip('/')}/partials/generation={generation}"


def refresh_partials(spark: SparkSession, silver_path: str, dataset: str = "reconciled") -> list[int]:
    """Write the partials of every generation that the table's state names and that has none yet; returns them."""
    state = V.days(spark, silver_path).where("rows > 0")
    named = [r.generation for r in state.select("generation").distinct().orderBy("generation").collect()]
    done = set(V.sub_numbers(spark, f"{silver_path.rstrip('/')}/partials", "generation="))
    made = [g for g in named if g not in done]
    for g in made:
        rows = V.generation_rows(spark, silver_path, g, dataset)
        aside = f"{silver_path.rstrip('/')}/partials/_writing-{g}"
        daily_partials(rows).repartition("biz_date").sortWithinPartitions("dimension", "biz_date").write.mode("overwrite").parquet(aside)
        V.rename(spark, aside, _folder(silver_path, g))
    return made


def read_partials(spark: SparkSession, silver_path: str, *, date_from=None, date_to=None) -> Partials:
    """The partials of the table's present state, over a range of days."""
    state = V.days(spark, silver_path).where("rows > 0")
    empty = daily_partials(spark.createDataFrame([], I._empty(spark, I.transaction_spec()).schema))
    if not V.sub_numbers(spark, f"{silver_path.rstrip('/')}/partials", "generation="):
        return Partials(empty, date_from, date_to)
    fields = [*empty.schema.fields, *state.select("generation").schema.fields]
    daily = spark.read.schema(type(empty.schema)(fields)).parquet(f"{silver_path.rstrip('/')}/partials")
    current = daily.join(state.select("generation", "biz_date"), ["generation", "biz_date"], "left_semi")
    return Partials(current.select(*empty.columns), date_from, date_to)
