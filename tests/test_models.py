"""Stages that ask a model, with stand-ins that fail in every way."""

import json

from pyspark.sql import functions as F

from tahlil.operators import gate, hybrid, models


def test_entities(spark):
    df = spark.createDataFrame([(1, "Hasta: Ayla Boztepe 12345678901"), (2, "HASTA: AYLA BOZTEPE GELDİ"), (3, None), (4, "")], "id int, text string")
    got = {r.id: [(s.text, s.label) for s in r.spans] for r in models.entities(df, "text", models.offline_entities).collect()}
    assert got == {1: [("Ayla Boztepe", "person"), ("12345678901", "national id")], 2: [("AYLA BOZTEPE", "person")], 3: [], 4: []}
    assert models.title_case("İZMİR IŞIK ab") == "İzmir Işık ab"


def broken():
    def chat(text):
        if "list" in text:
            return '{"findings": "none"}'
        if "json" in text:
            return "no json"
        return "<think>x</think> " + json.dumps({"findings": [{"text": t, "type": "person", "reason": r} for t, r in (("Ayla", "isim"), ("uydurma", ""), ("HASTA ADI", ""), ("kanser", "tıbbi terim"))]})

    return chat


def test_judge_fails_closed(spark):
    df = spark.createDataFrame([(1, "HASTA ADI: AYLA, kanser"), (2, "list"), (3, "json"), (4, None)], "id int, text string")
    done = models.judged(df, "text", broken)
    got = {r.id: r.judge for r in done.collect()}
    assert [f.text for f in got[1].findings] == ["Ayla"] and got[1].error is None
    assert got[2].error == "NotAList" and got[3].error == "AttributeError" and got[4].error is None
    passed = {r.id: r.gate.passed for r in gate.checked(done, "text", judge=F.col("judge")).collect()}
    assert passed == {1: False, 2: False, 3: False, 4: False}


def flaky():
    seen = {}

    def complete(text):
        seen[text] = seen.get(text, 0) + 1
        if text == "slow" and seen[text] < 3:
            raise TimeoutError("secret text")
        if text == "never":
            raise TimeoutError
        if text == "wrong":
            raise ValueError("secret text")
        return {"stop_reason": {"no": "refusal", "long": "max_tokens"}.get(text), "text": '```json\n{"a": 1}\n```'}

    return complete


def test_answers(spark):
    df = spark.createDataFrame([("ok", True), ("slow", True), ("never", True), ("wrong", True), ("no", True), ("long", True), ("out", False), ("null", None)], "text string, allowed boolean").coalesce(1)
    got = {r.text: r for r in models.answered(df, "text", flaky).collect()}
    assert {k: (r.outcome, len(r.attempts)) for k, r in got.items()} == {"ok": ("done", 1), "slow": ("done", 3), "never": ("failed", 3), "wrong": ("failed", 1), "no": ("refused", 1), "long": ("cut", 1), "out": ("blocked", 0), "null": ("blocked", 0)}
    assert got["ok"].json == '{"a": 1}' and "secret" not in str(got)


def test_inlined():
    s = {"properties": {"a": {"$ref": "#/$defs/A"}, "b": [{"$ref": "#/$defs/A", "title": "t"}]}, "$defs": {"A": {"type": "string"}}}
    assert models.inlined(s) == {"properties": {"a": {"type": "string"}, "b": [{"type": "string", "title": "t"}]}}


def test_hybrid(spark):
    df = spark.createDataFrame([(1, "Hasta: Ayla Boztepe, no 12345678901, 12.05.2024 tarihinde meme karsinom"), (2, None), (3, "temiz")], "id int, text string")
    got = {r.id: r.masked for r in hybrid.masked(df, "text", models.offline_entities).collect()}
    assert "Boztepe" not in got[1] and "12345678901" not in got[1] and "2024" not in got[1] and "meme karsinom" in got[1]
    assert got[2] is None and got[3] == "temiz"


def learns():
    def chat(text):
        return '{"findings": [{"text": "Ayla", "type": "person", "reason": ""}]}' if "Önceki yanıtın başı: olmadı" in text else "olmadı"

    return chat


def test_judge_is_told_what_was_wrong(spark):
    df = spark.createDataFrame([(1, "Ayla geldi")], "id int, text string")
    assert [f.text for f in models.judged(df, "text", learns).first().judge.findings] == ["Ayla"]
    assert models.judged(df, "text", learns, attempts=1).first().judge.error == "AttributeError"


def test_every_attempt_is_allowed_anew(spark):
    df = spark.createDataFrame([("slow", True), ("never", True)], "text string, allowed boolean").coalesce(1)

    def allow(text):
        return text != "never"

    got = {r.text: r for r in models.answered(df, "text", flaky, wait=0.01, allow=allow).collect()}
    assert got["slow"].outcome == "done" and got["never"].outcome == "blocked" and [a.outcome for a in got["never"].attempts] == ["blocked"]
