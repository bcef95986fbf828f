"""A copy of a table laid out by order id.

Rows are hashed to buckets by id, sorted by it and written with Parquet bloom filters on it.  An
aggregate or a join on the id then needs no exchange of the table, and a lookup reads the buckets
of its ids and, in these, the row groups whose range and bloom filter may hold one.

A hot id (the null id of a third of all rows) belongs to one bucket, but not to one task: AQE's
rebalancing splits its partition, and the bucket gets several files.

The layout is kept beside the rows, so that any session can open the table by its path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggs import quoted

LAYOUT = "id_col string, buckets int, ddl string"
IDS_A_ROW_GROUP = 1_000_000      # the bloom filter's size follows from this


def write_by_id(df: DataFrame, path: str, *, buckets: int, id_col: str = "order_id", options: dict[str, str] | None = None) -> None:
    """Write ``df`` below ``path`` in ``buckets`` buckets by ``id_col``; ``options`` are those of Parquet."""
    spark, root = df.sparkSession, path.rstrip("/")
    name = _name(root)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = (df.hint("rebalance", buckets, quoted(id_col)).write.format("parquet").mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col)
              .option(f"parquet.bloom.filter.enabled#{id_col}", "true").option(f"parquet.bloom.filter.expected.ndv#{id_col}", str(IDS_A_ROW_GROUP)))
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    writer.option("path", f"{root}/rows").saveAsTable(name)
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
    spark.createDataFrame([(id_col, buckets, ddl)], LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")


def read_by_id(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`write_by_id` wrote below ``path``, with its layout known to the planner."""
    root = path.rstrip("/")
    name = _name(root)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema(LAYOUT).parquet(f"{root}/layout").first()
        column = "`" + layout.id_col.replace("`", "``") + "`"
        spark.sql(f"CREATE TABLE {name} ({layout.ddl}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) "
                  f"INTO {layout.buckets} BUCKETS LOCATION '{root}/rows'")
    return spark.table(name)


def _name(root: str) -> str:
    """A table name that follows from the folder."""
    return f"by_id_{hashlib.sha256(root.encode()).hexdigest()[:16]}"


def lookup(table: DataFrame, ids: DataFrame, *, id_col: str = "order_id") -> DataFrame:
    """F1 on a table laid out by id: rows whose id is in the one-column table ``ids`` (trimmed, blanks dropped);
    only the ids are exchanged."""
    wanted = ids.select(F.trim(quoted(ids.columns[0])).alias("_id")).where("_id is not null and _id <> ''").distinct()
    return table.join(wanted, quoted(id_col) == F.col("_id"), "left_semi")
