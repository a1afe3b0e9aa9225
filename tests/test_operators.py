"""Spans, gate, names, categories, metrics and jobs on fresh examples."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tahlil.operators import classify, gate, jobs, metrics, names, spans

SPAN = "array<struct<start:int,end:int,text:string,label:string,score:double>>"


def brute_merge(xs):
    out = []
    for s in sorted(xs, key=lambda s: (s[0], s[0] - s[1], -s[4])):
        if out and s[0] < out[-1][1]:
            a = out[-1]
            better = (s[1] - s[0], s[4]) > (a[4], a[3])
            out[-1] = (a[0], max(a[1], s[1]), s[3] if better else a[2], s[4] if better else a[3], s[1] - s[0] if better else a[4])
        else:
            out.append((s[0], s[1], s[3], s[4], s[1] - s[0]))
    return [(a, b, c) for a, b, c, _, _ in out]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from("ab"), st.integers(0, 9)), max_size=6), min_size=1, max_size=20))
def test_merge_against_brute_force(spark, many):
    rows = [(i, [(s, s + n, "t", lab, sc / 10) for s, n, lab, sc in xs]) for i, xs in enumerate(many)]
    df = spark.createDataFrame(rows, f"id int, spans {SPAN}")
    got = {r.id: [(s.start, s.end, s.label) for s in r.m] for r in df.select("id", spans.merged(F.col("spans")).alias("m")).collect()}
    assert got == {i: brute_merge(xs) for i, xs in rows}


def test_touching_spans_stay_apart_and_overlay(spark):
    df = spark.createDataFrame([("abcdefgh", [(2, 4, "cd", "person", 0.5), (0, 2, "ab", "x", 0.5)]), (None, None), ("ab", [])], f"t string, spans {SPAN}")
    assert [r[0] for r in df.select(spans.overlaid(F.col("t"), F.col("spans"))).collect()] == ["[PII_SILINDI][KISI_SILINDI]efgh", None, "ab"]


def test_chunks_put_together_give_the_text(spark):
    text = "bir iki üç\n" + "kelime " * 70 + "\nson satır"
    rows = spans.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text", 20).orderBy("chunk_no").collect()
    assert "".join(r.chunk for r in rows) == text and all(text[r.offset :].startswith(r.chunk) and len(r.chunk.split()) <= 20 for r in rows)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("finding", "text", "want"), [("[DOKTOR_SILINDI] ERDEM", "Dr. erdem geldi", True), ("[ISIM_SILINDI]", "x", False), ("Dr. Ayşe Kaya", "AYŞE hanım, KAYA bey", True), ("uydurma", "metin", False), ("x", "x", False)])
def test_finding_real(spark, finding, text, want):
    assert one(spark, gate.is_real(F.col("f"), F.col("t")), f=finding, t=text) is want


def test_filters(spark):
    assert one(spark, gate.is_label_only(F.col("f")), f="HASTA ADI SOYADI:") is True
    assert one(spark, gate.is_label_only(F.col("f")), f="HASTA AYLA") is False
    assert one(spark, gate.is_medical_code(F.col("f"), F.lit("id")), f="C34.9") is True
    assert one(spark, gate.is_self_refuting(F.col("f"), F.col("r")), f="kanser", r="tıbbi terim") is True
    assert one(spark, gate.is_self_refuting(F.col("f"), F.col("r")), f="12345678", r="tıbbi terim") is False
    assert one(spark, gate.deleted_tokens(F.col("b"), F.col("a")), b="AYLA HASTA 123456", a="HASTA") == ["123456", "AYLA"]


def test_gate_fails_closed_and_egress(spark):
    df = spark.createDataFrame([(1, "temiz metin", ["Ayla Akdal"]), (2, "12345678901 kaldı", []), (3, "AYLA AKDAL burada", ["Ayla Akdal"]), (4, None, None)], "id int, text string, candidates array<string>")
    g = {r.id: r.gate for r in gate.checked(df, "text", "candidates").collect()}
    assert [g[i].passed for i in (1, 2, 3, 4)] == [True, False, False, False] and g[2].findings[0].type == "id"
    broken = gate.checked(df, "text", judge=F.struct(F.array().cast(gate.FINDINGS).alias("findings"), F.lit("Timeout").alias("error")))
    assert not broken.first().gate.passed
    assert gate.checked(df, "text", enabled=False).first().gate.passed
    d = gate.checked(df.filter("id = 1"), "text", "candidates").withColumn("decision", gate.decision(F.col("text"), F.col("gate.passed"), F.col("candidates")))
    assert gate.released(d, ["text"]).count() == 1
    dates = spark.createDataFrame([("1.2.24",), ("0332 310 50 00",), ("hastanesi",)], "t string").select(gate.decision(F.col("t"), F.lit(True), F.array(F.lit("Devlet Hastanesi"))).alias("d")).collect()
    assert [r.d.allowed for r in dates] == [False, False, True]


def test_names(spark):
    lexicon = spark.createDataFrame([("AYLA", True, False), ("BOZTEPE", False, True), ("UMUT", True, True)], "token string, is_first boolean, is_surname boolean")
    docs = spark.createDataFrame([(1, "Ayla Boztepe geldi"), (2, "Umut verici"), (3, "TANI:\nAYLA BOZTEPE\nDr. X\nBOZTEPE AYLA"), (4, None), (5, ""), (6, "ayla akdere"), (7, "A. Boztepe ve Ayla Hanım, B boztepe")], "id int, text string")
    assert sorted((r.id, r.line_no, r.w1) for r in names.name_pairs(docs, lexicon, "id", "text").collect()) == [(1, 0, "Ayla"), (3, 3, "BOZTEPE"), (6, 0, "ayla"), (7, 0, "A"), (7, 0, "Ayla")]
    masked = {r.id: r.masked for r in names.mask_names(docs, lexicon, "id", "text").collect()}
    assert masked[1] == "[ISIM_SILINDI] geldi" and masked[2] == "Umut verici" and masked[4] is None
    assert names.name_pairs(docs, lexicon.limit(0), "id", "text").count() == 0


def test_misread_places(spark):
    docs = spark.createDataFrame([(1, "TRAPZON ANKARA KARSİNOM ADANA TRAEZONDM")], "id int, text string")
    assert {(r.token, r.place) for r in names.misread_places(docs, "id", "text").collect()} == {("TRAPZON", "Trabzon"), ("TRAEZONDM", "Trabzon")}


@pytest.mark.parametrize(("raw", "want"), [("Lung", "Lung"), ("soft tissue", "Soft_Tissue"), ("lung cancer", "Lung"), ("KEMİK İLİĞİ", "Bone_Marrow"), ("bilinmeyen", "Other"), ("", "Other"), ("bilinmeyen_eyes", "Other")])
def test_category(spark, raw, want):
    assert one(spark, classify.category(F.col("r")), r=raw) == want


def test_json_of(spark):
    for said, want in (('{"a": 1}', '{"a": 1}'), ('<think>{"b"}</think>x {"a": {"c": 2}} y', '{"a": {"c": 2}}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ("hiç", None)):
        assert one(spark, classify.json_of(F.col("r")), r=said) == want


def test_validation_branches(spark):
    def v(cat, conf, text):
        return one(spark, classify.validated(F.lit(cat), F.lit(conf), F.col("t"), F.lit("")), t=text)

    long = " ve başka bulgular da izlenmiştir, ayrıntı aşağıda" * 2
    assert v("Lung", 0.9, "akciğer dokusu" + long).is_valid
    conflict = v("Lung", 0.9, "akciğer ve beyin, meningiom, glioblastom" + long)
    assert conflict.confidence_adjusted == 0.63 and conflict.best_category == "Brain"
    assert v("Thymus", 0.9, "beyin, meningiom" + long).confidence_adjusted == 0.9  # no keyword of its own: no penalty
    short = v("Lung", 0.9, "akciğer")
    assert short.confidence_adjusted == 0.45 and short.warnings[-1] == classify.SHORT_WARNING
    assert v("Pleura", 0.9, "akciğer ve plevra" + long).best_category == "Lung"  # the first among equals


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in (4, 1, 3, 2)] + [("b", 5.0), ("b", None), ("c", None)], "g string, x double")
    assert {r.g: r.x_median for r in metrics.upper_median(df, ["g"], "x").collect()} == {"a": 3.0, "b": 5.0}
    assert one(spark, metrics.error_rate(F.col("a"), F.col("b")), a="İki satır\n\n burada", b="iki satir burada") == round(1 / 16, 4)
    fz = spark.createDataFrame([("Ayla Bozteqe geldi", "Ayla Boztepe"), ("no 12 34", "12.34"), (None, "x"), ("x", None), ("abc", "")], "h string, n string")
    assert [r.found for r in metrics.contains_fuzzy(fz, "h", "n").collect()] == [True, True, False, False, False]


def test_jobs(spark):
    log = spark.createDataFrame([("a", 1, "queued"), ("a", 3, "done"), ("a", 2, "processing"), (None, 9, "x"), ("b", 1, "queued"), ("b", 1, "queued")], "job_id string, ts int, status string")
    assert sorted((r.job_id, r.status) for r in jobs.latest(log, "job_id", "ts", ["status"]).collect()) == [("a", "done"), ("b", "queued")]
    with pytest.raises(ValueError):
        jobs.recent(log, 501)


def test_running_means(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i, float(i * i % 7) if i % 5 else None) for i in range(200)], "k string, i int, v double").repartition(5)
    got = {r.i: r.running_mean for r in jobs.running_means(df, "k", "v", ["i"]).collect()}
    sums = {}
    for i in range(200):
        k = "a" if i % 3 else None
        s, n = sums.get(k, (0.0, 0))
        if i % 5:
            s, n = s + i * i % 7, n + 1
        sums[k] = s, n
        assert got[i] == (pytest.approx(s / n) if n else None)


def test_written_and_cleared(spark):
    from tahlil import session

    df = session.written(spark.range(5), "test")
    assert df.count() == 5
    session.clear(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        df.count()


@settings(max_examples=150, deadline=None)
@given(st.text("abcdeçş 1", max_size=40), st.text("abcdeçş 1", min_size=1, max_size=12))
def test_alike_is_what_every_window_says(hay, needle):
    every = any(SequenceMatcher(None, hay[i : i + w], needle, False).ratio() >= 0.85 for w in (len(needle) - 2, len(needle), len(needle) + 2) if 0 < w <= len(hay) for i in range(len(hay) - w + 1))
    assert metrics.alike(hay, needle, 0.85) == every


def test_upper_median_of_any_values(spark):
    rng = random.Random(1)
    rows = [("a", rng.random() ** 9 * 1e6) for _ in range(2_001)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 5.0)] * 7 + [(None, float(x)) for x in (3, 1, 2, 9)] + [("d", None)]
    got = {r.g: r.x_median for r in metrics.upper_median(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    for g in ("a", "b", "c", None):
        x = sorted(v for k, v in rows if k == g)
        assert got[g] == x[len(x) // 2]
    assert "d" not in got
