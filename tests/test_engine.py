"""The whole engine: misread provinces and names of the dictionary among the layers."""

import pytest
from pyspark.sql import functions as F

from tahlil.operators import engine, gate, names
from tahlil.plans import pipeline, queries

LEXICON = [("AYLA", True, False), ("BOZTEPE", False, True), ("UMUT", True, True)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, is_first boolean, is_surname boolean")


def test_engine_holds_names_and_misread_places(spark, lexicon):
    rows = [(1, "Kayıtta ayla boztepe yazılı, TRAPZON'DA bakıldı"), (2, None), (3, "TANI:\nADENOKARSİNOM\nTC Kimlik No: 12345678901"), (4, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in engine.masked(docs, lexicon, "id").collect()}
    assert got[1].masked == "Kayıtta [ISIM_SILINDI] yazılı, [SEHIR_SILINDI] bakıldı"
    assert got[1].fields_removed == ["Şehir (bozuk okunmuş)", "İsim (sözlük)"]
    assert got[2].masked is None and got[4].masked == "" and "ADENOKARSİNOM" in got[3].masked and "12345678901" not in got[3].masked
    assert "TRAPZON" in {r.id: r for r in engine.masked(docs, lexicon, "id", remove_institutions=False).collect()}[1].masked
    both = {r.id: r.masked for r in pipeline.masked(docs, lexicon, "id").collect()}
    assert both[1] == got[1].masked


def test_a14_takes_names_and_misread_places(spark, lexicon, tmp_path):
    spark.createDataFrame([(1, "Kayıtta ayla boztepe yazılı, TRAPZON geçer")], "ocr_id long, text string").write.parquet(f"{tmp_path}/ocr_result.parquet")
    lexicon.write.parquet(f"{tmp_path}/name_lexicon.parquet")
    assert queries.a14_engine(spark, str(tmp_path)).first().masked == "Kayıtta [ISIM_SILINDI] yazılı, [SEHIR_SILINDI] geçer"


def test_misread_is_what_the_join_finds(spark):
    words = ["TRAPZON", "TRAEZONDM", "TRABZON", "ANKARA", "ANKRA", "ADANA", "KARSİNOM", "BATIN", "KARAMAN", "KANAMA", "İSTANBLU", "DIYARBAKIRDM", "SAMSUM", "KAHRAMANMARSS", "MERSINM", "MUGLA"]
    docs = spark.createDataFrame([(1, " ".join(words))], "id int, text string")
    joined = {r.token for r in names.misread_places(docs, "id", "text").collect()}
    assert joined <= {w for w in words if names.misread(w)} and {"TRAPZON", "SAMSUM"} <= joined
    assert names.without_misread_places("TRABZON KARSİNOM BATIN ankra") == "TRABZON KARSİNOM BATIN ankra"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ayla  boztepe geldi", "[ISIM_SILINDI] geldi"),
        ("Ayla, Boztepe", "Ayla, Boztepe"),
        ("Ayla Akdere Boztepe geldi", "[ISIM_SILINDI] geldi"),
        ("Ayla Boztepe Umut geldi", "[ISIM_SILINDI] geldi"),
        ("A. Boztepe ve B.Boztepe", "[ISIM_SILINDI] ve [ISIM_SILINDI]"),
        ("AVI SOXAOT: AYLA ERDOĞDU", "AVI SOXAOT: [ISIM_SILINDI]"),
        ("TETKİK: AYLA ERDOĞDU", "TETKİK: AYLA ERDOĞDU"),
        ("'SEDA BOZTEPE geldi", "[ISIM_SILINDI] geldi"),
        ("sile AEA: Xyz", "[ISIM_SILINDI]"),
        ("Kontrol DR BOZTEPE ile", "Kontrol [DOKTOR_SILINDI] ile"),
        ("[DOKTOR_SILINDI] ERDEM .\nx", "[DOKTOR_SILINDI]\nx"),
        ("[WEB_SILINDI] Ayla Erdem", "[WEB_SILINDI] [ISIM_SILINDI]"),
        ("Umut verici", "Umut verici"),
        ("TANI:\nAYLA ERDEM: x\n'SEDA BOZTEPE\nDR BOZTEPE", "TANI:\nAYLA ERDEM: x\n'SEDA BOZTEPE\n[DOKTOR_SILINDI]"),
    ],
)
def test_sub_rules(text, want):
    known = {w: (f, s) for t, f, s in LEXICON for w in (t, t.capitalize(), t.lower())}
    medical = [text.startswith("TANI")] * (text.count("\n") + 1)
    assert names.without_names(text, known, medical)[0] == want


@pytest.mark.parametrize("most", [200_000, 1])
def test_names_through_the_join(spark, lexicon, monkeypatch, most):
    monkeypatch.setattr(names, "SENT_ROWS", most)
    docs = spark.createDataFrame([(1, "XX YY: AYLA ERDOĞDU\nDR BOZTEPE", []), (None, "ayla boztepe", []), (2, None, []), (2, "TANI:\nayla boztepe", [])], "id int, text string, removed array<string>")
    got = sorted((r.id or 0, r.text or "", r.removed) for r in names.mask_all_names(docs, lexicon, "id", "text", "removed").collect())
    assert got == [(0, "[ISIM_SILINDI]", ["İsim (sözlük)"]), (1, "XX YY: [ISIM_SILINDI]\n[DOKTOR_SILINDI]", ["İsim (bozuk etiket + sözlük)", "Doktor (DR+sözlük)"]), (2, "", []), (2, "TANI:\nayla boztepe", [])]


def test_names_are_replaced_by_their_place(spark, lexicon):
    rows = [
        (1, "AYLA  BOZTEPE ve AYLA\tBOZTEPE geldi"),
        (2, "AYLA, BOZTEPE"),
        (3, "Ayla Boztepe geldi, AYLABOZTEPELI ve SAYLA BOZTEPELI kaldı"),
        (4, "Ayla Boztepe\nTANI:\nAyla Boztepe bulgusu"),
        (5, "Rapor Ayla\nHanım tarafından"),
        (6, None),
        (7, ""),
    ]
    docs = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.masked for r in names.mask_names(docs, lexicon, "id", "text").collect()}
    assert got[1] == "[ISIM_SILINDI] ve [ISIM_SILINDI] geldi" and got[2] == "AYLA, BOZTEPE"
    assert got[3] == "[ISIM_SILINDI] geldi, AYLABOZTEPELI ve SAYLA BOZTEPELI kaldı"
    assert got[4] == "[ISIM_SILINDI]\nTANI:\nAyla Boztepe bulgusu" and got[6] is None and got[7] == ""
    whole = names.mask_all_names(docs.selectExpr("id", "text", "cast(array() as array<string>) as removed"), lexicon, "id", "text", "removed")
    assert {r.id: r.text for r in whole.collect()}[5] == "Rapor [ISIM_SILINDI]\nHanım tarafından"


def test_sections_of_a_long_text(spark):
    text = "\n".join(["giriş", "TANI:", *["satır"] * 5_000, "Uzm. Dr. X", "son", "BULGULAR", "", "x"])
    got = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(names.in_sections(F.col("text")).alias("s")).collect()
    assert got[0].s == [False, *[True] * 5_001, False, False, True, True, True] and got[1].s == [False] and got[2].s is None


def test_gate_finds_names_of_the_dictionary(spark, lexicon):
    rows = [(1, "SAYIN AYLA BOZTEPE geldi"), (2, "AVI SOXAOT: Ayla Tanınmayan"), (3, "AVI SOXAOT: Ayla Servis"), (4, "Ayla geldi"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    g = {r.id: r for r in gate.checked(df, "text", lexicon=lexicon).select("id", "gate.passed", "gate.findings").collect()}
    assert [[f.text for f in g[i].findings] for i in range(1, 7)] == [["AYLA BOZTEPE"], ["Ayla Tanınmayan"], [], [], [], []]
    assert [g[i].passed for i in range(1, 7)] == [False, False, True, True, False, True]
    d = df.select("id", gate.decision(F.col("text"), F.lit(True), F.array().cast("array<string>")).alias("d")).collect()
    assert {r.id: r.d.allowed for r in d} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_gate_asks_an_entity_model(spark):
    df = spark.createDataFrame([(1, "Ayla geldi", [("Ayla", "person", 0.9), ("Yok", "person", 0.8)]), (2, "temiz", None)], "id int, text string, seen array<struct<text:string,label:string,score:double>>")
    g = {r.id: r.gate for r in gate.checked(df, "text", entities=F.col("seen")).select("id", "gate").collect()}
    assert [f.text for f in g[1].findings] == ["Ayla"] and not g[1].passed and g[2].passed and "entity_model" in g[2].layers_run
