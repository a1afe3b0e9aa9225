"""All stages together: nothing goes out that should not."""

from tahlil.operators import gate, metrics
from tahlil.plans import pipeline


def test_stages(spark):
    lexicon = spark.createDataFrame([("AYLA", True, False), ("BOZTEPE", False, True)], "token string, is_first boolean, is_surname boolean")
    rows = [
        (1, "Hasta: Ayla Boztepe\nTC Kimlik No: 12345678901\nTANI: nevüs", None, ["Ayla Boztepe", "12345678901", "Örnek Hastanesi"], ["nevüs"]),
        (2, "Kayıt ZERRİNLİ diye geçer", "Hasta: ZERRİNLİ SOYLU", [], []),
        (3, None, None, None, None),
        (4, "", None, [], None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, text string, other string, pii array<string>, keep array<string>, gate string")
    d = pipeline.decided(pipeline.masked(df, lexicon, "id"), other="other")
    got = {r.id: r for r in d.collect()}
    assert got[1].gate.passed and got[1].decision.allowed and "nevüs" in got[1].masked
    assert not got[2].gate.passed and got[2].decision.reasons == ["kapi_gecilmedi", "aday_kaldi"]
    assert not got[3].gate.passed and got[4].gate.passed
    assert {r.id for r in gate.released(d, ["id", "masked"]).collect()} == {1, 4}
    (r,) = metrics.leaks(d.selectExpr("*", "'all' as g", "gate.passed as passed"), ["g"], passed="passed").collect()
    assert (r.n, r.pii_total, r.leaked, r.keep_total, r.over_deleted, r.gate_pass_with_leak) == (4, 2, 0, 1, 0, 0)
