"""Masking layers on fresh examples: what must go, what must stay, and that order matters."""

import pytest
from pyspark.sql import functions as F

from tahlil.operators import rules


def run(spark, text, layer=None, **flags):
    df = spark.createDataFrame([(text,)], "text string")
    if layer:
        return df.select(rules.layer(layer, F.col("text"))).first()[0]
    return rules.masked(df, **flags).first()


@pytest.mark.parametrize(
    ("layer", "text", "gone", "kept"),
    [
        ("a01", "T.C. Kimlik No: 12345678901, kan 5", "12345678901", "kan 5"),
        ("a01", "no 98765432109 idi", "98765432109", "idi"),
        ("a01", "12345678901234", "yok", "12345678901234"),
        ("a01", "25******976 son", "25***", "son"),
        ("a02", "Protokol No: 1234/25 bulgu", "1234/25", "bulgu"),
        ("a02", "Örnek B-12345/24 alındı", "B-12345/24", "alındı"),
        ("a03", "Adı Soyadı: AYLA BOZTEPE Yaş: 40", "BOZTEPE", "Yaş: 40"),
        ("a03", "Hasta: Berk Akdal\nTANI: nevüs", "Akdal", "TANI: nevüs"),
        ("a03", "Gönderen: Prof. Dr. Ceren Durmaz", "Durmaz", ""),
        ("a04", "Uzm. Dr. Elvan Cankır gördü", "Cankır", "gördü"),
        ("a05", "12.05.2024 ve 2024-05-12 ve 3 nisan", "2024", "ve"),
        ("a05", "lenf nodu 10/15 pozitif", "yok", "10/15"),
        ("a05", "kabul tarihi 02/25", "02/25", ""),
        ("a08", "Tel: 0532 111 22 33 son", "0532", ""),
        ("a08", "yaz: a.b@ornek.example son", "a.b@", "son"),
        ("a09", "Dip. Tescil No: 12345 Dr", "12345", "Dr"),
        ("a20", "Kimlik 930-558-885-75 ve 98938 756896 son", "930", "son"),
        ("a20", "İletişim 0 504.090.38.99 ya da 0299/1135899 ya da 502-699-6261 son", "504", "son"),
        ("a20", "yaz: x_y(at)ornek.example ya da z @ ornek . example son", "ornek", "son"),
        ("a20", "Ev: Gül Mah. Lale Sok. No: 4/5 Taşova\nTarih", "Lale", "Tarih"),
        ("a20", "60. Sokak No 8 Yenice\nkesit 2,5 cm", "Sokak", "kesit 2,5 cm"),
        ("a20", "Barkod 4343170044378 ve 12 mm", "yok", "4343170044378"),
        ("a04", "Patolog Ceren Boztepe-Akdal\nson", "Akdal", "son"),
        ("a12", "İşlem No: 1234567 ve 51441/23", "51441", "ve"),
    ],
)
def test_layer(spark, layer, text, gone, kept):
    out = run(spark, text, layer)
    assert gone not in out and kept in out


@pytest.mark.parametrize(("age", "low"), [(3, 0), (45, 35), (57, 45), (80, 75), (119, 105)])
def test_age_ranges(spark, age, low):
    assert f"[YAS_ARALIGI: {low}-{low + 9}]" in run(spark, f"{age} yaşında hasta", "a06")
    assert run(spark, f"Yaş: {age} / k", "a06") == f"[YAS_ARALIGI: {low}-{low + 9}] / K"


def test_age_limits_and_first_label_only(spark):
    assert run(spark, "120 yaşında", "a06") == "120 yaşında"
    assert run(spark, "Yaş: 40, Yaş: 50", "a06").endswith("Yaş: 50")


def test_places_only_as_names(spark):
    assert "[SEHIR_SILINDI]" in run(spark, "KONYADAN geldi", "a07")
    assert run(spark, "kan van gibi aksın", "a07") == "kan van gibi aksın"


def test_diploma_before_titles(spark):
    out = run(spark, "Dr. Ayla Akdal Dip. Tescil No: 98765").masked
    assert "98765" not in out


def test_null_empty_flags_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "x", ["y"]), (2, "", "x", ["y"]), (3, "12.05.2024", "x", ["y"])], "id int, text string, masked string, fields_removed array<string>")
    rows = {r.id: r for r in rules.masked(df).collect()}
    assert rows[1].masked is None and rows[1].fields_removed == [] and rows[2].masked == ""
    assert rows[3].fields_removed == ["gün.ay.yıl"]
    assert run(spark, "12.05.2024 45 yaşında", remove_dates=False, generalize_age=False).masked == "12.05.2024 45 yaşında"
    assert rules.masked(df.limit(0)).count() == 0


def test_very_long_text(spark):
    out = run(spark, "kelime " * 50_000 + "12.05.2024").masked
    assert out.endswith("[TARIH_SILINDI]")


def test_institutions_by_line_and_directorate(spark):
    rows = ["T.C.\nÖrnek metin", "T. C. SAĞLIK BAKANLIĞI Örnek\nTANI: x", "örnekli il sağlık müdürlüğü yazısı", "TCKN yazılı\nATC kodu", "sonu T.C. değil"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(rules.layer("a07", F.col("t"))).collect()]
    assert got == ["[KURUM_SILINDI]\nÖrnek metin", "[KURUM_SILINDI]\nTANI: x", "[KURUM_SILINDI] yazısı", "TCKN yazılı\nATC kodu", "sonu T.C. değil"]
