"""Sinks: run tables, JSON results, tagged corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import tagged_text


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append a run's rows to a table of runs, a folder per run, so that a run can be read or replaced alone."""
    df.write.mode("overwrite").parquet(f"{path}/run={run_id}")


def append_log(df: DataFrame, path: str) -> None:
    """Append rows (ts, level, message) as log lines ``ts - level - message``."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    df.select(F.concat_ws(" - ", stamp, "level", "message").alias("value")).write.mode("append").text(path)


def write_results_json(df: DataFrame, path: str, **metadata: str) -> None:
    """One JSON object per row, with the same metadata in each."""
    df.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in metadata.items()), F.struct("*").alias("result"))).alias("value")).write.mode("overwrite").text(path)


def write_tagged(df: DataFrame, path: str, doc_no: str = "doc_no", content: str = "content") -> None:
    """Records that ``readers.tagged_documents`` reads."""
    df.select(tagged_text(F.col(doc_no).cast("string"), F.col(content)).alias("value")).write.mode("overwrite").text(path)
