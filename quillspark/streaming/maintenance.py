"""Structured Streaming: index maintenance and windowed request counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.index import Index, build, load, merge


def maintain_index(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the documents of a stream to an index under ``path``, a partial index per batch.

    A batch's folder is named by its id and overwritten if the batch is run
    again, so results are exactly once. ``merge_parts`` makes one index of them.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        build(batch).save(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_parts(spark: SparkSession, path: str) -> Index:
    """One index of all batches that ``maintain_index`` has written under ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folders = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return merge(*(load(spark, str(f.getPath().toString())) for f in folders if f.isDirectory() and f.getPath().getName().startswith("batch=")))


def request_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests per window and type, for a stream or a table of (ts, event_type); later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
