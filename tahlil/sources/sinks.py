"""Tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_files(df: DataFrame, key: str, text: str, path: str) -> None:
    """One folder of text for each key value."""
    df.select(F.col(key).cast("string").alias("key"), text).write.partitionBy("key").mode("overwrite").text(path)


def csv_export(df: DataFrame, order: str, path: str) -> bool:
    """All columns as one CSV file with a header and a byte order mark, sorted; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    first, *_ = df.columns
    flat = df.select(*(F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns))
    flat.orderBy(order).coalesce(1).withColumnRenamed(first, "﻿" + first).write.mode("overwrite").csv(path, header=True)
    return True


def append(df: DataFrame, path: str) -> None:
    """Rows added to a log."""
    df.write.mode("append").parquet(path)


def json_rows(df: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    df.write.mode("overwrite").json(path)
