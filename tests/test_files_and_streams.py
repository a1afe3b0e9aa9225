"""Sources, sinks and streams on folders of their own."""

import json

from pyspark.sql import functions as F

from tahlil.sources import files, sinks
from tahlil.streaming import jobs as stream


def test_files(spark, tmp_path):
    for name, content in (("a.txt", "bir\niki".encode()), ("b.TXT", b"\xffx"), ("c.exe", b"no"), ("d.txt", b""), ("e.txt", b"y" * 100)):
        (tmp_path / name).write_bytes(content)
    got = files.files(spark, str(tmp_path), most_bytes=50)
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.txt", "b.TXT"]
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(got).collect()}
    assert texts == {"a.txt": "bir\niki", "b.TXT": "�x"}


def reader(content: bytes):
    if content == b"bad":
        raise ValueError("secret")
    yield from content.decode("utf-8", "replace").split("\n")


def test_pages_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("sayfa bir\nsayfa iki".encode())
    (tmp_path / "b.txt").write_bytes(b"bad")
    pages = files.pages(files.files(spark, str(tmp_path)), reader, "test")
    assert {(r.page_no, r.text, r.error) for r in pages.collect()} == {(0, "sayfa bir", None), (1, "sayfa iki", None), (0, None, "ValueError")}
    docs = {r.path.rsplit("/", 1)[1]: (r.text, r.pages) for r in files.documents(pages).collect()}
    assert docs["a.txt"] == ("sayfa bir\n\nsayfa iki", 2)


def test_manifest_dictionary_settings(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps([{"file": "x_1.png", "kind": "a"}, {"file": "y.png", "kind": "b"}]))
    (tmp_path / "x_1.gt.txt").write_text("gerçek")
    assert {(r.file, r.truth) for r in files.manifest(spark, str(tmp_path)).collect()} == {("x_1.png", "gerçek"), ("y.png", None)}
    (tmp_path / "kw.json").write_text(json.dumps({"B": ["b1"], "A": ["a1", "a2"]}))
    assert [(r.category, r.keyword) for r in files.dictionary(spark, str(tmp_path / "kw.json")).orderBy("cat_ord", "kw_ord").collect()] == [("B", "b1"), ("A", "a1"), ("A", "a2")]
    assert files.settings({"gate": {"enabled": True, "n": 3}}, "APP", {"APP_GATE__ENABLED": "false", "APP_GATE__N": "7", "APP_X__Y": "1", "OTHER": "1"}) == {"gate": {"enabled": False, "n": 7}}


def test_routing(spark):
    df = spark.createDataFrame([("uzun " * 20, "kısa"), ("kısa", "uzun " * 20), ("kısa", ""), (None, None)], "a string, b string")
    got = df.select(files.routed(F.col("a"), F.col("b")).alias("r"), files.completeness(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.r is not None and r.r[:4] for r in got] == ["uzun", "uzun", "kısa", False] and got[2].c == 1.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", ["x"]), (1, "a", [])], "id int, t string, l array<string>")
    assert sinks.csv_export(df, "id", str(tmp_path / "csv")) and not sinks.csv_export(df.limit(0), "id", str(tmp_path / "none"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    lines = part.read_text("utf-8").splitlines()
    assert lines[0].startswith("﻿id") and lines[1].startswith("1,")
    sinks.append(df, str(tmp_path / "log"))
    sinks.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.json_rows(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.text_files(df, "id", "t", str(tmp_path / "text"))
    assert (tmp_path / "text" / "key=1").is_dir()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("A", 0.2), ("B", 0.5)], "k string, v double").coalesce(1).write.parquet(f"{src}/1")
    schema = spark.read.parquet(f"{src}/1").schema
    stream.running_means(stream.rows(spark, f"{src}/*", schema), "k", "v", out, check).awaitTermination()
    spark.createDataFrame([("A", 0.4), ("A", None)], "k string, v double").coalesce(1).write.parquet(f"{src}/2")
    stream.running_means(stream.rows(spark, f"{src}/*", schema), "k", "v", out, check).awaitTermination()
    got = {r.k: (r.total_count, round(r.avg_confidence, 6)) for r in stream.current_means(spark, out, "k").collect()}
    assert got == {"A": (3, 0.3), "B": (1, 0.5)}


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Tel: 0532 111 22 33")
    (tmp_path / "in" / "b.exe").write_text("x")
    q = stream.write_batches(stream.landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), lambda df: df.selectExpr("path", "length"))
    q.awaitTermination()
    assert [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.txt"]


def test_states(spark, tmp_path):
    spark.createDataFrame([("j", 1, "queued"), ("j", 2, "done")], "job_id string, ts int, status string").write.parquet(str(tmp_path / "log"))
    assert stream.states(spark, str(tmp_path / "log")).first().status == "done"


def test_pages_of_layer_and_image(spark):
    layer = spark.createDataFrame([("a", 0, "uzun " * 20), ("a", 1, "kısa"), ("a", 2, None), ("b", 0, "kısa")], "path string, page_no int, text string")
    read = spark.createDataFrame([("a", 0, "okunan", "x"), ("a", 1, "okunan", "x"), ("a", 2, "okunan", "x"), ("c", 0, "okunan", "x")], "path string, page_no int, text string, engine string")
    got = {(r.path, r.page_no): (r.engine, (r.text or "")[:4]) for r in files.paged(layer, read).collect()}
    assert got == {("a", 0): ("katman", "uzun"), ("a", 1): ("x", "okun"), ("a", 2): ("x", "okun"), ("b", 0): ("katman", "kısa"), ("c", 0): ("x", "okun")}
    assert files.paged(layer.limit(0), read.limit(0)).count() == 0


def test_written_manifest(spark, tmp_path):
    cases = spark.createDataFrame([("x_1", "x_1.png", "bir\niki"), ("y", "y.png", None), ("z", "z.png", "")], "id string, file string, text string")
    files.write_manifest(cases, str(tmp_path / "m"))
    assert {r.id: r.truth for r in files.manifest(spark, str(tmp_path / "m")).collect()} == {"x_1": "bir\niki", "y": None, "z": ""}
