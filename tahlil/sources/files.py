"""Files as tables: texts, images and scanned documents, manifests, dictionaries, and made-up forms."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tahlil.operators.jobs import ALLOWED, suffix


def files(spark: SparkSession, path: str, endings: tuple[str, ...] = ALLOWED, most_bytes: int | None = None) -> DataFrame:
    """(path, length, content) of the files below a folder with one of the endings, in no order (sorting would move all contents; sort
    paths where the order matters); larger ones than `most_bytes` are left out before they are read. Files of no bytes have no
    row, as Spark's scan leaves them out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(suffix(F.col("path")).isin(*endings))
    return (df.filter(F.col("length") <= most_bytes) if most_bytes is not None else df).select("path", "length", "content")


def texts(df: DataFrame) -> DataFrame:
    """(path, text) of text files in UTF-8; bytes that are none become U+FFFD."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f.path, "text": [bytes(b).decode("utf-8", "replace") for b in f.content]})

    return df.filter(suffix(F.col("path")).isin(".txt", ".text")).select("path", "content").mapInPandas(run, "path string, text string")


def pages(df: DataFrame, reader: Callable[[bytes], Iterator[str]], engine: str) -> DataFrame:
    """(path, page_no, text, engine): what a reader finds on the pages of each file, pages from 0. The reader is made
    for the worker that runs it; an error gives one row with null text and the error's type, never its message."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f.path, f.content, strict=True):
                try:
                    rows += [(path, i, t, engine, None) for i, t in enumerate(reader(bytes(content)))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, None, engine, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "engine", "error"])

    return df.select("path", "content").mapInPandas(run, "path string, page_no int, text string, engine string, error string")


def routed(primary: Column, fallback: Column, least_chars: int = 50) -> Column:
    """The primary reading if it has characters enough, else the fallback, else what there is."""
    enough = F.length(F.trim(primary)) >= least_chars
    return F.when(enough, primary).otherwise(F.coalesce(F.when(F.length(F.trim(fallback)) > 0, fallback), primary))


def completeness(primary: Column, other: Column) -> Column:
    """How much the primary reading has of the other, by characters, to two places; 1 if there is no other."""
    return F.when(other.isNull() | (F.length(other) == 0), F.lit(1.0)).otherwise(F.bround(F.length(primary) / F.length(other), 2))


INCOMPLETE = "ikincil okumaya göre eksik"  # the warning of a reading that has too little of the other


def warnings(primary: Column, other: Column, least: float = 0.6) -> Column:
    """The warnings of a reading: one if it has less than a share `least` of the other."""
    return F.array_compact(F.array(F.when(completeness(primary, other) < least, F.lit(INCOMPLETE))))


def paged(layer: DataFrame, read: DataFrame, least_chars: int = 50, engine: str = "katman") -> DataFrame:
    """(path, page_no, text, engine): of each page the text layer of the document (path, page_no, text) where it has more than
    `least_chars` characters, else what was read from its image (path, page_no, text, engine), else what there is. Pages
    of either side alone stay."""
    a = layer.select("path", "page_no", F.col("text").alias("__a"))
    b = read.select("path", "page_no", F.col("text").alias("__b"), F.col("engine").alias("__e"))
    both = a.join(b, ["path", "page_no"], "full_outer")
    own = F.coalesce(F.length(F.trim("__a")) > least_chars, F.lit(False)) | F.col("__b").isNull()
    return both.select("path", "page_no", F.when(own, F.col("__a")).otherwise(F.col("__b")).alias("text"), F.when(own, F.lit(engine)).otherwise(F.col("__e")).alias("engine"))


def resolution(width: Column, height: Column, wanted: int = 300, budget: int = 25_000_000) -> Column:
    """Dots per inch for a page of so many inches that keep it within a budget of pixels, 72 at least."""
    return F.least(F.lit(wanted), F.greatest(F.lit(72), F.floor(F.sqrt(F.lit(float(budget)) / (width * height))))).cast("int")


def documents(read: DataFrame) -> DataFrame:
    """(path, text, pages, page_engines): the pages of each file put together in order, a blank line between."""
    page = F.sort_array(F.collect_list(F.struct("page_no", "text", "engine")))
    got = read.groupBy("path").agg(page.alias("p"))
    return got.select("path", F.array_join(F.col("p.text"), "\n\n").alias("text"), F.size("p").alias("pages"), F.col("p.engine").alias("page_engines"))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The images of a benchmark with their truth: a JSON list in `meta.json`, and beside each image a text of the same stem; or
    what `write_manifest` has written."""
    here = is_folder(spark, f"{path}/meta.json")
    items = spark.read.json(f"{path}/meta.json", multiLine=not here)
    truth = spark.read.option("recursiveFileLookup", "true").text(f"{path}/truth" if here else f"{path}/*.gt.txt", wholetext=True)
    value = F.regexp_replace("value", "\n$", "") if here else F.col("value")
    truth = truth.select(F.regexp_extract(F.input_file_name(), "([^/=]+)\\.gt\\.txt", 1).alias("stem"), value.alias("truth"))
    return items.withColumn("stem", F.regexp_replace("file", "\\.[^.]+$", "")).join(truth, "stem", "left").drop("stem")


def write_manifest(cases: DataFrame, path: str) -> None:
    """The manifest of cases (file, text, and what else is known of them): one JSON object a case, and each text in a file under the
    stem of its case's file. Both are written by the tasks, so there may be any number."""
    cases.drop("text").write.mode("overwrite").json(f"{path}/meta.json")
    named = cases.filter("text is not null").select(F.regexp_replace("file", "\\.[^.]+$", ".gt.txt").alias("name"), "text")
    named.write.mode("overwrite").partitionBy("name").text(f"{path}/truth")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(category, cat_ord, keyword, kw_ord) of a JSON object of lists, in the file's order."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.posexplode(F.map_entries("m")).alias("cat_ord", "e")).select(F.col("e.key").alias("category"), "cat_ord", F.posexplode("e.value").alias("kw_ord", "keyword"))


def settings(defaults: dict, prefix: str, environment: dict[str, str] | None = None) -> dict:
    """Settings with overrides of the environment: PREFIX_SECTION__KEY, in the type of the default."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for name, raw in (environment if environment is not None else dict(os.environ)).items():
        if not name.startswith(f"{prefix}_") or "__" not in name:
            continue
        section, key = name[len(prefix) + 1 :].lower().split("__", 1)
        like = out.get(section, {}).get(key) if isinstance(out.get(section), dict) else None
        if like is None:
            continue
        out[section][key] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(like, bool) else type(like)(raw)
    return out


FIRST, LAST = ("AYLA", "BERK", "CEREN", "DORUK", "ELVAN"), ("AKDAL", "BOZTEPE", "CANKIR", "DURMAZ")


def forms(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """(form_id, text): made-up forms, one for each order, by arithmetic on the keys alone."""
    j = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    lines = (
        text("Hasta Adi Soyadi: ", pick(FIRST, c % 5), " ", pick(LAST, o % 4)),
        text("TC Kimlik No: ", F.lit(10_000_000_000) + o * 7919 + c),
        text("Protokol No: ", F.lit(10_000) + o % 80_000, "/", F.lit(20) + o % 7),
        text("Tarih: ", F.date_format("o_orderdate", "dd.MM.yyyy"), "    Yas: ", F.lit(20) + c % 70),
        text("Tel: 05", F.lit(30) + o % 30, " ", F.lit(100) + c % 900, " 12 34"),
        text("Gonderen Doktor: Uzm. Dr. ", pick(FIRST, o % 5), " ", pick(LAST, c % 4)),
        F.lit("TANI:"),
        text("bulgu ", F.lower("n_name")),
    )
    return j.select(F.col("o_orderkey").alias("form_id"), F.concat_ws("\n", *lines).alias("text"))
