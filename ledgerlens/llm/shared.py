"""Tables in the shared folder that ``spark.checkpoint.dir`` names, and Arrow map steps."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_path, ship_package


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def map_arrow(df: DataFrame, step, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers.  ``mapInArrow`` reads names as
    expressions; columns with other characters than letters, digits and ``_`` are numbered
    inside, so a step takes a batch's columns by place."""
    ship_package(df.sparkSession)
    if all(c.isidentifier() for c in df.columns):
        return df.mapInArrow(step, schema)
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    if isinstance(schema, str):
        return numbered.mapInArrow(step, schema)
    inner = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    return numbered.mapInArrow(step, inner).toDF(*schema.names)


def returning(step):
    """``step``, after which the worker returns the memory that it has freed: workers serve many tasks, and else keep
    the most that any of them took."""
    def run(batches):
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc alone
        if trim:
            trim(0)

    return run


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that nothing has used, below the shared folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


#: Remove a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch that a Python step gets; without it, batches of 10 000 rows however long.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def kept_table(df: DataFrame, name: str, compression: str = "zstd", batch_bytes: int | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and the table's path: its
    lineage is cut and executors can be lost without computing it anew.  The shuffle files of
    the write, which nothing reads again, go at once instead of with the driver's garbage.  Python
    steps get batches of about ``batch_bytes``, or one row."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    put = {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, compression: str = "zstd", batch_bytes: int | None = None) -> DataFrame:
    """:func:`kept_table` without the path: the table stays until the shared folder is cleaned."""
    return kept_table(df, name, compression, batch_bytes)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table after its last reader."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
