"""The table of jobs and its log of events: latest states, lists, counts, and running means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tahlil.session import written

ALLOWED = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".txt")  # endings of files that are taken (fixed values)
LIST_COLUMNS = ("id", "created_at", "started_at", "finished_at", "status", "filename", "ref", "size_bytes", "error")


def suffix(name: Column) -> Column:
    """The ending of a file name, in lower case, with its dot; empty if it has none."""
    return F.regexp_extract(F.lower(name), "(\\.[^.]+)$", 1)


def to_seconds(at: Column) -> Column:
    """A time without its fractions of a second."""
    return F.date_trunc("second", at)


def latest(events: DataFrame, key: str, at: str, tie: list[str]) -> DataFrame:
    """The last event of each key. Grouped with a maximum, not sorted: each task keeps one row for a key before the
    exchange, so a key with most of the rows is no burden. Rows without a key are left out."""
    rest = [c for c in events.columns if c != key]
    order = F.struct(at, *tie)
    got = events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("e"))
    return got.select(key, *(F.col(f"e.{c}").alias(c) for c in rest))


def recent(jobs: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """The newest jobs (1 to 500), the id deciding among equals; without results and digests."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    some = jobs.filter(F.col("status") == status) if status else jobs
    return some.orderBy(F.desc("created_at"), "id").limit(limit).select(*LIST_COLUMNS)


def stale(jobs: DataFrame) -> DataFrame:
    """The jobs after a restart: what was queued or being processed has failed."""
    lost = F.col("status").isin("queued", "processing")
    return jobs.withColumns({"error": F.when(lost, F.lit("yarıda kaldı")).otherwise(F.col("error")), "status": F.when(lost, F.lit("failed")).otherwise(F.col("status"))})


def means(df: DataFrame, by: str, value: str, at: str | None = None) -> DataFrame:
    """Count and exact mean of a value by group, and the last time; works on streams in update mode as well."""
    more = [F.max(at).alias("last_updated")] if at else []
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total_count"), F.avg(value).alias("avg_confidence"), *more)


def running_means(df: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """Each row with the mean of its group so far; rows without a value change nothing.

    A group may hold most of the rows, so it is not sorted by one task: the rows are cut into ranges of the order, every
    range sums up its own rows, and starts from the sums of the ranges before it.
    """
    cut = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running")
    sums = cut.groupBy(by, "__part").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))
    joined = cut.join(base, (F.col(by).eqNullSafe(F.col("__by"))) & (F.col("__part") == F.col("__at")))
    w = Window.partitionBy(by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.try_divide(F.col("__s0") + F.coalesce(F.sum(value).over(w), F.lit(0.0)), F.col("__n0") + F.count(value).over(w))
    return joined.withColumn("running_mean", mean).select(*df.columns, "running_mean")
