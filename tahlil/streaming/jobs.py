"""Streams: files as they land, masked in batches; the log of job events; running means by category.

A restart goes on from the checkpoint, so nothing is lost or done twice: results are written by batch number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tahlil.operators.jobs import ALLOWED, latest, means, suffix


def landing(spark: SparkSession, path: str, most_files: int = 20, most_bytes: int | None = None) -> DataFrame:
    """Files as they land in a folder, at most so many in a batch; others than the allowed, and too large ones, are
    left out."""
    df = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most_files).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    df = df.filter(suffix(F.col("path")).isin(*ALLOWED))
    return df.filter(F.col("length") <= most_bytes) if most_bytes is not None else df


def rows(spark: SparkSession, path: str, schema: StructType, most_files: int = 20) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Everything there is now, in batches, each put through `step` and written below its number, so that a batch that
    is done again after a failure overwrites itself."""

    def put(df: DataFrame, number: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_means(stream: DataFrame, by: str, value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Count and mean of a value by group over all that has come: the changed groups of each batch are written below its
    number; the newest of a group holds."""
    agg = means(stream, by, value)

    def put(df: DataFrame, number: int) -> None:
        df.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return agg.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_means(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The newest row of each group that `running_means` has written."""
    got = spark.read.parquet(path).drop("batch")
    return latest(got, by, "batch_no", []).drop("batch_no")


def states(spark: SparkSession, path: str) -> DataFrame:
    """The state of each job: its last event."""
    return latest(spark.read.parquet(path), "job_id", "ts", ["status"])
