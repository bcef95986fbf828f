"""Incremental landing of daily CSV drops into the silver table (Structured Streaming).

The stream is the file listing: a ``binaryFile`` source whose content is never read, so
each micro-batch holds the names of newly arrived files.  Because a ``_2`` file *replaces*
its day (it is not appended), a batch is not appended either: ``foreachBatch`` takes the
days that the new names touch and replaces exactly these by their latest files, all at once
(:func:`ledgerlens.sources.silver.refresh_silver`); a day whose re-issue is empty is cleared.
Re-running a batch after a failure finds the days as they are and writes nothing, so the sink
is idempotent; the stream's checkpoint, beside the silver table, records which files were
seen, also across applications.  Spark's file source does not report a file that is rewritten
under its name or deleted: a scheduled ``refresh_silver`` without ``days`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import catalog as C
from ..sources.silver import refresh_silver

LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def listing_stream(spark: SparkSession, base_path: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    """The names of newly arrived files."""
    reader = (spark.readStream.format("binaryFile").schema(LISTING)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(base_path).select("path")


def land_batch(batch: DataFrame, silver_path: str, dataset: str, base_path: str, multi_line: bool = False) -> None:
    """Replace the days that a batch of file names touches by their latest files."""
    spark = batch.sparkSession
    touched = C.parse_paths(batch).where((F.col("dataset") == dataset) & F.col("biz_date").isNotNull())
    days = [r.biz_date for r in touched.select("biz_date").distinct().collect()]     # days, not files or rows
    if days:
        refresh_silver(spark, base_path, f"{silver_path.rstrip('/')}/{dataset}", dataset, days=sorted(days), multi_line=multi_line)


def start_landing(spark: SparkSession, base_path: str, silver_path: str, *, dataset: str = "reconciled",
                  checkpoint: str | None = None, available_now: bool = True, multi_line: bool = False,
                  processing_time: str | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the landing stream for one data set.

    ``available_now`` processes every file present and stops (a scheduled
    incremental job); otherwise ``processing_time`` (e.g. ``"5 minutes"``) keeps
    it running.  The checkpoint defaults to a folder below ``silver_path``, the same for
    every application, whose name readers of the table pass over.
    """
    checkpoint = checkpoint or f"{silver_path.rstrip('/')}/_checkpoints/{dataset}"
    stream = listing_stream(spark, base_path, max_files_per_trigger=max_files_per_trigger)
    writer = (stream.writeStream
              .foreachBatch(lambda batch, _epoch: land_batch(batch, silver_path, dataset, base_path, multi_line))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
