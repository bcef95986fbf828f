"""Column -> Column label expressions (pure, JVM-side, codegen friendly).

None of these is a Python UDF: each is a ``CASE WHEN`` chain that stays inside
whole-stage code generation.  Null is always handled explicitly so no row falls
through a predicate by three-valued logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def service_label(c: str | Column) -> Column:
    """normal -> Ride (Normal), express -> Express (any case), null/'' -> unknown, else raw."""
    c = _col(c)
    low = F.lower(c)
    return (F.when(c.isNull() | (c == ""), F.lit(S.SERVICE_UNKNOWN_LABEL))
            .when(low == S.SERVICE_NORMAL_RAW, F.lit(S.SERVICE_NORMAL_LABEL))
            .when(low == S.SERVICE_EXPRESS_RAW, F.lit(S.SERVICE_EXPRESS_LABEL))
            .otherwise(c))


def business_label(c: str | Column) -> Column:
    """true/1/yes -> Business, false/0/no -> Non-Business, else 'Unknown (<raw>)'."""
    c = _col(c).cast("string")
    low = F.lower(c)
    return (F.when(low.isin(*S.BUSINESS_TRUE_TOKENS), F.lit(S.BUSINESS_LABEL))
            .when(low.isin(*S.BUSINESS_FALSE_TOKENS), F.lit(S.NON_BUSINESS_LABEL))
            .otherwise(F.concat(F.lit(S.UNKNOWN_LABEL + " ("), F.coalesce(c, F.lit("null")), F.lit(")"))))


def is_business(c: str | Column) -> Column:
    """Boolean flag (null-safe: unknown values are ``False``)."""
    return F.coalesce(F.lower(_col(c).cast("string")).isin(*S.BUSINESS_TRUE_TOKENS), F.lit(False))


def reconcile_class(c: str | Column) -> Column:
    """match / only_m / only_external / other; null status is its own class ``unknown``.

    Order matters: equality with ``match`` first, then the two substring tests.
    """
    c = _col(c)
    return (F.when(c.isNull(), F.lit("unknown"))
            .when(c == S.STATUS_MATCH, F.lit("match"))
            .when(c.contains(S.STATUS_ONLY_M), F.lit("only_m"))
            .when(c.contains(S.STATUS_ONLY_EXTERNAL), F.lit("only_external"))
            .otherwise(F.lit("other")))


def contains_flag(c: str | Column, needle: str) -> Column:
    """Substring test where null is ``False`` (never unknown)."""
    return F.coalesce(_col(c).contains(needle), F.lit(False))


def severity(c: str | Column) -> Column:
    """Merchant-status severity: fail/error -> bad, success/match -> good, else neutral."""
    low = F.lower(_col(c).cast("string"))
    bad = F.lit(False)
    for w in S.SEVERITY_BAD_WORDS:
        bad = bad | F.coalesce(low.contains(w), F.lit(False))
    good = F.lit(False)
    for w in S.SEVERITY_GOOD_WORDS:
        good = good | F.coalesce(low.contains(w), F.lit(False))
    return F.when(bad, F.lit("bad")).when(good, F.lit("good")).otherwise(F.lit("neutral"))


def is_failed(c: str | Column) -> Column:
    return severity(c) == F.lit("bad")


def vehicle_class(c: str | Column) -> Column:
    """Platform amount 100 -> Bike, 200 -> Car, anything else (null included) -> other."""
    c = _col(c)
    return (F.when(c == S.VEHICLE_BIKE_AMOUNT, F.lit(S.VEHICLE_BIKE))
            .when(c == S.VEHICLE_CAR_AMOUNT, F.lit(S.VEHICLE_CAR))
            .otherwise(F.lit(S.VEHICLE_OTHER)))


def parse_order_time(c: str | Column) -> Column:
    """Tolerant wall-clock parse of ``S.ORDER_TIME_FORMAT`` to ``TIMESTAMP_NTZ``: a bad value
    becomes null.

    One cast of the texts that have the format's shape; without a time zone, so the hour
    and the min/max do not depend on the session zone (no DST shift).
    """
    txt = _col(c).cast("string")
    return F.when(txt.rlike(S.ORDER_TIME_SHAPE), txt).try_cast(T.TimestampNTZType())


def order_time(df: DataFrame, column: str) -> Column:
    """A time column of ``df``: as it is when it is typed, else parsed."""
    typed = isinstance(df.schema[column].dataType, (T.TimestampNTZType, T.TimestampType))
    return F.col(column) if typed else parse_order_time(column)
