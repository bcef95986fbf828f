"""Types of the columns that no alias names, from all of their cells.

The types form a lattice: a column that holds whole numbers alone is ``bigint``, with other
numbers ``double``, true and false alone ``boolean``, anything else ``string``.  A cell's
candidates are a bit mask; a column's state is its number of cells and the bitwise *and* of
their masks.  States merge by sum and *and*, in any order, so those of two days give that of both
without a look at the rows, and no sample decides: the last cell counts like the first.

A number with leading zeros is a number, as in the source's scanner; a whole number beyond 64
bits is a double; white space around a number makes it a string.  A column without cells is a
string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggs import quoted

WHOLE, NUMBER, BOOLEAN = 1, 2, 4
_WHOLE_SHAPE = r"^[+-]?[0-9]+\z"
_NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
STATE = "column string, cells bigint, mask int"


def candidates(cell: Column) -> Column:
    """Types that can hold a cell's text, as a bit mask; null for null."""
    return (F.when(cell.isNull(), F.lit(None).cast("int"))
            .when(cell.rlike(_WHOLE_SHAPE) & cell.try_cast("bigint").isNotNull(), WHOLE | NUMBER)
            .when(cell.rlike(_NUMBER_SHAPE), NUMBER)
            .when(F.lower(cell).isin("true", "false"), BOOLEAN).otherwise(0))


def column_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, cells, mask)`` of the text ``columns`` that have a cell: one scan, partial aggregates."""
    if not columns:
        return df.sparkSession.createDataFrame([], T.StructType([*(df.schema[b] for b in by), *T.StructType.fromDDL(STATE).fields]))
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("cell")) for c in columns]))
    return (df.select(*by, cells).where("cell is not null").groupBy(*by, "column")
            .agg(F.count("cell").alias("cells"), F.bit_and(candidates(F.col("cell"))).alias("mask")))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of several parts of a table as those of the whole."""
    return states.groupBy(*by, "column").agg(F.sum("cells").alias("cells"), F.bit_and("mask").alias("mask"))


def type_of(mask: int | None) -> T.DataType:
    for bit, kind in ((WHOLE, T.LongType()), (NUMBER, T.DoubleType()), (BOOLEAN, T.BooleanType())):
        if mask is not None and mask & bit:
            return kind
    return T.StringType()


def resolved(states: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """The type of each of ``columns``; a row for each column reaches the driver, as schema."""
    masks = {r["column"]: r["mask"] for r in merge_states(states).collect()}
    return {c: type_of(masks.get(c)) for c in columns}
