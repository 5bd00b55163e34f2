"""Intermediate tables in the folder that all executors share.

Lineage is cut with written Parquet tables under ``spark.checkpoint.dir``. An
executor that is lost later costs nothing but a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.shared import new_path


class Scratch:
    """A folder of named intermediate tables for one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.uri = new_path(spark, label)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
