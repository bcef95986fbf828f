"""Aggregate building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def ensure(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with every one of ``columns``: one that a file did not have is null, in its
    canonical type, so its measures are zero or null."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(S.CANONICAL_TYPES.get(c, T.StringType()))
                           for c in dict.fromkeys(columns) if c not in have}) if set(columns) - have else df


def unique_counts(df: DataFrame, by: Sequence[str], measures: dict[str, str], base: DataFrame) -> DataFrame:
    """``base`` (one row for each ``by`` group) with a distinct count, null included, for each
    ``{name: column}``.

    Each count is a two-level aggregate of its own over its column alone: no row is copied
    for every measure before the first aggregate.  The small results meet by the group.
    """
    names = [c for c in base.columns if c not in by]
    parts = [base.select(*by, *names, *[F.lit(None).cast("bigint").alias(m) for m in measures])]
    for name, column in measures.items():
        counted = df.select(*by, F.col(column).alias("_value")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))
        parts.append(counted.select(*by, *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in names],
                                    *[(F.col(m) if m == name else F.lit(None).cast("bigint")).alias(m) for m in measures]))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy(*by).agg(*[F.max(c).alias(c) for c in names], *[F.coalesce(F.max(m), F.lit(0)).alias(m) for m in measures])


def money_sum(c: str | Column) -> Column:
    """Exact decimal sum, returned as double (null when there is no value)."""
    return F.sum(_col(c)).cast("double")


def ratio_pct(num: str | Column, den: str | Column) -> Column:
    """``num / den * 100`` in double precision; null when the denominator is 0 or null."""
    return F.try_divide(_col(num).cast("double") * F.lit(100.0), _col(den).cast("double"))


def mean_of(total: str | Column, count: str | Column) -> Column:
    """``total / count`` as double, null when ``count`` is 0."""
    return F.try_divide(_col(total).cast("double"), _col(count).cast("double"))


def with_share(grouped: DataFrame, count_col: str, by: Sequence[str] | None = None,
               out: str = "percent") -> DataFrame:
    """Add ``count / total * 100`` to a grouped result (A0).

    Without ``by`` the total is a scalar subquery over the grouped counts.  It names
    every column of the grouped result, so it is the same aggregate and Spark
    reuses its exchange: the base is scanned once.  With ``by`` (e.g. one share
    per ``biz_date``) the total comes from a window partitioned by those keys over
    the small grouped result.
    """
    if not by:
        total = whole(grouped, F.sum(count_col))
    else:
        total = F.sum(count_col).over(Window.partitionBy(*by))
    return grouped.withColumn(out, ratio_pct(count_col, total))


def whole(grouped: DataFrame, value: Column) -> Column:
    """An aggregate over all rows of a grouped result, as a scalar subquery that shares the
    grouped result's exchange."""
    rest = [F.max(c).alias(f"_{i}") for i, c in enumerate(grouped.columns)]
    return grouped.select(F.struct(value.alias("value"), *rest)).scalar().getField("value")


def keys(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)
