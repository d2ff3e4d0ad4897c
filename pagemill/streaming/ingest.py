"""Streaming ingest: new page files become postings batch by batch; late page events are counted in windows.

The stream's checkpoint takes the place of a check for existing outputs: a file is taken once. Each micro-batch is
written under its id, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import retrieval as R


def page_stream(spark: SparkSession, directory: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Pages from Parquet files that arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def index_stream(pages: DataFrame, index: R.Index, checkpoint: str, text: str = "content", once: bool = True) -> StreamingQuery:
    """Appends each batch's postings and lengths to the index, whose searches then see them."""

    def upsert(batch: DataFrame, number: int) -> None:
        index.add(batch, number, text)

    writer = pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """by, window start and count per tumbling window; events later than the watermark are left out of a stream.

    Works on a stream and on a table; a timestamp without zone is taken as the session's.
    """
    stamped = events.withColumn("_t", F.col(time).cast("timestamp"))
    return stamped.withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("window_start"), "events")
