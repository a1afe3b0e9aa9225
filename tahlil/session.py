"""Session helpers: tables, the shared scratch folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


HOME = str(Path(__file__).resolve().parent.parent)


@cache
def _zipped() -> str:
    """The package as an archive."""
    return shutil.make_archive(f"{tempfile.mkdtemp()}/tahlil", "zip", HOME, "tahlil")


BATCH_BYTES = 16 << 20  # most bytes of an Arrow batch; rows are texts, so their number says little


def ship(spark: SparkSession) -> None:
    """Makes the package known to Python workers: by its place on one machine, as an archive on a cluster. Batches that
    go to them are kept small in bytes, for long texts."""
    sc = spark.sparkContext
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    if sc.master.startswith("local"):
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([HOME, *filter(None, sc.environment.get("PYTHONPATH", "").split(os.pathsep))]))
    elif not any(f.endswith("tahlil.zip") for f in sc.listFiles):
        sc.addPyFile(_zipped())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores, where the files give fewer: for work that is much heavier than
    the exchange of its input. Where the input has tasks enough, nothing is exchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def made(sent, make):
    """What a Python worker makes of a broadcast value, made once in each worker process and kept with the value."""
    if (got := getattr(sent, "_made", None)) is None:
        got = sent._made = make(sent.value)
    return got


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    Only in local mode, where the session may name none (tests), a folder of this machine is set. On a cluster such a
    folder would not be shared, so a session without one is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file:///tmp/tahlil-scratch-{os.getuid()}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a table in the shared folder. All of an application's tables are below one folder, which is removed
    when the application's driver ends, or by `clear`."""
    own = f"{shared_dir(spark)}/tahlil/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as a compressed columnar table in the shared folder and read back.

    Cuts the lineage like checkpoint(), but keeps the columnar form, so that later reads prune columns.
    """
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application wrote to the shared folder; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tahlil/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
