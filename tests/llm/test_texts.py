"""Terms, pieces, forms, personal data and scanned pages on fresh examples."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tahlil.llm import canonical, personal, scanned, skeleton, split


# -- 2: canonical terms
def test_canonical(spark):
    terms = spark.createDataFrame([(1, "ad", "Kreatinin", None), (2, "ad", "LDH", []), (3, "primer_bolge", "Mide", ["Gaster"])], "term_id long, field string, term string, aliases array<string>")
    markers = spark.createDataFrame([(1, "Kreatinin", 5), (2, "kreatnin", 5), (3, None, 5), (4, "", 5), (5, "zzz", 5), (5, "zzz", 5)], "marker_id long, ad string, term_id int")
    reports = spark.createDataFrame([(7, "karsinom", "GASTER"), (8, None, None)], "report_id long, histolojik_tip string, primer_bolge string")
    m = canonical.mapped(canonical.values(markers, reports), terms)
    assert sorted((r.field, r.rec_id, r.term_id) for r in canonical.found(m, terms).collect()) == [("ad", 2, 1), ("ad", 4, 0), ("ad", 5, 0), ("ad", 5, 0), ("histolojik_tip", 7, 0), ("primer_bolge", 7, 3)]
    assert {(r.value, r.n) for r in canonical.misses(m).collect()} == {("", 1), ("zzz", 2), ("karsinom", 1)}
    assert canonical.mapped(canonical.values(markers, reports), terms.limit(0)).filter("term_id <> 0").count() == 0
    assert canonical.mapped(canonical.values(markers.limit(0), reports.limit(0)), terms).count() == 0


def test_long_lists_are_refused(spark, monkeypatch):
    terms = spark.createDataFrame([(i, f"f{i}", "x", None) for i in range(4)], "term_id long, field string, term string, aliases array<string>")
    typed = spark.createDataFrame([("f1", 1, "x")], "field string, rec_id long, value string")
    monkeypatch.setattr(canonical, "FORMS_MOST", 3)
    with pytest.raises(ValueError):
        canonical.mapped(typed, terms)
    monkeypatch.setattr(canonical, "FORMS_MOST", 4)  # several fields together within the bound: all are known
    every = spark.createDataFrame([(f"f{i}", i, "x") for i in range(4)], "field string, rec_id long, value string")
    assert sorted(r.term_id for r in canonical.mapped(every, terms).collect()) == [0, 1, 2, 3]
    monkeypatch.setattr(personal, "NAMES_MOST", 1)
    with pytest.raises(ValueError):
        personal.lexicon(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([("A", True, True), ("B", True, True)], "token string, is_first boolean, is_surname boolean"))


# -- 3: pieces
@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from("ab c.\n\f şğ"), max_size=600), st.integers(20, 80), st.integers(0, 19))
def test_pieces(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(e - b <= limit for b, e, _ in got)
    assert all(b2 == e1 - overlap and e2 > e1 for (_, e1, _), (b2, e2, _) in zip(got, got[1:], strict=False))
    assert (len(got) > 1) == (len(text) > limit)


def test_cut_at_the_topic():
    a, b = "Böbrek dokusu ve tübül hücreleri. " * 4, "Yıldız kümesi ve teleskop zamanı. " * 4
    (_, end, kind), *_ = split.pieces(a + b, 190, 10)
    assert kind == "sentence" and end == len(a)
    # the deepest valley decides, not the kind of boundary: a blank line within the first topic is no reason
    (_, end, kind), *_ = split.pieces(a[:99] + "\n\n" + a[99:] + b, 190, 10)
    assert kind == "sentence" and end == len(a) + 2
    paged = "satır bir ve daha\nsatır iki ve daha çok\f" + "x " * 40
    assert split.pieces(paged, 60, 5)[0][1:] == (paged.index("\f") + 1, "page")
    assert split.pieces("x" * 50, 20, 5)[0] == (0, 20, "none")
    with pytest.raises(ValueError):
        split.pieces("x", 10, 10)


def test_long_words_stay_whole():
    text = "ab " * 100 + "x" * 1_750 + " cd" * 100
    got = split.pieces(text)
    assert [k for _, _, k in got[:-1]] == ["word"] * (len(got) - 1) and any(text[b:e].count("x") == 1_750 for b, e, _ in got)
    assert split.pieces("ab\f" + "x" * 40, 20, 1)[0] == (0, 3, "page")


def test_split(spark):
    rows = [("t", "1", None), ("t", "2", ""), ("t", "3", "a" * 2_000), ("t", "4", "kelime " * 1_000), ("t", "4", "kelime " * 1_000), ("t", "5", "ş" * 2_001)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "tbl string, rec_key string, text string, piece int")
    got = split.split(df)
    assert sorted(r.rec_key for r in split.oversized(got).collect()) == ["4", "4", "5"]
    assert got.filter("rec_key = '1'").count() == 0 and got.filter("rec_key = '2'").first().piece == ""
    assert got.filter("length(piece) > 2000").count() == 0 and split.split(df.limit(0)).count() == 0


# -- 4: look-alikes
@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ｈａｓｔａ １２", "Hasta 12"),
        ("ı̇zmir şifa", "izmir şifa"),
        ("şifa İzmir", "şifa İzmir"),
        ("a​b c d﻿", "ab c d"),
        ("Наѕtа Yеlkеn", "Hasta Yelken"),
        ("ОКТАN", "OKTAN"),
        ("ΟΚΤΑΝ", "OKTAN"),
        ("β-hCG ve α-fetoprotein", "β-hCG ve α-fetoprotein"),
        ("Пациент говорит по-русски", "Пациент говорит по-русски"),
        ("satır\n\x0csayfa", "satır\n\x0csayfa"),
        ("𝐇𝑎𝓼𝔱𝕒 ﬁlm Ⅳ ⓐ ﾊ", "Hasta film IV a ハ"),
        ("10³ ½ H₂O µg ① 5 №", "10³ ½ H₂O µg ① 5 №"),
        ("ՕKTAN Ꮋasta ꓮYLA Ⲟktan Ꭺyla", "OKTAN Hasta AYLA Oktan Ayla"),
        ("Բարեւ ձեզ", "Բարեւ ձեզ"),
        ("a\u00a0b\u2003c\u3000d\te\u205ff", "a b c d e f"),
        ("", ""),
    ],
)
def test_skeleton(text, form):
    assert skeleton.skeleton(text) == form and skeleton.skeleton(form) == form


def test_forms_and_groups(spark):
    ocr = spark.createDataFrame([(1, "Оktan", "x"), (2, "Oktan", "x"), (3, None, "x"), (4, "", "x")], "ocr_id long, text string, form string")
    cases = spark.createDataFrame([("a", ["Oktan", None, "Ｏktan"]), ("b", None), ("c", [])], "id string, pii array<string>")
    f = skeleton.formed(skeleton.entries(ocr, cases), "text")
    assert sorted((r.rec_key, r.pos) for r in f.filter(skeleton.changed("text")).collect()) == [("1", -1), ("a", 2)]
    assert {(r.form, r.n_rows, r.n_originals) for r in skeleton.groups(f).collect()} == {("Oktan", 4, 3), ("", 1, 1)}
    assert skeleton.formed(skeleton.entries(ocr.limit(0), cases.limit(0)), "text").count() == 0


# -- 5: personal data
FORM = "Hasta: {n} Yaş: 40\nTC Kimlik No: {i}\nTel: 0532 111 22 33\nEv: Çınarlı Mah. Gül Sok. No: 4/5 Taşova\nTANI: Gleason 7, deniz kenarında yaşıyor.\nPatolog {d}"


@pytest.fixture(scope="module")
def done(spark):
    first, last = ["AYLA", "BERK", "CEREN", "DORUK", "ELVAN"], ["BOZTEPE", "CANKIR", "DURMAZ", "AKDAL"]
    rng = random.Random(3)
    rows = [("t", str(i), FORM.format(n=f"{rng.choice(first).title()} {rng.choice(last).title()}", i=rng.randrange(10**10, 10**11), d=f"{rng.choice(first)} {rng.choice(last)}")) for i in range(60)]
    rows += [
        ("t", "a", "Bilgi için ayla.boztepe [at] ornek [nokta] example, Ayla Boztepe Hanım aranabilir (0 532.111.22.33)."),
        ("t", "b", "Barkod 02345678901 ile arşivlendi. Parti no 4343170044378 kullanıldı."),
        ("t", "c", "Aуlа Вoztepe adına düzenlenen fatura Gül Caddesi 12, Taşova adresine postalandı."),
        ("t", "d", ""),
        ("t", "e", "Deniz kenarında bahar geldi."),
        ("t", "f", "C. Boztepe (987 654 321 09) onam verdi. " + "uzun metin " * 20_000),
    ]
    names = spark.createDataFrame([("AYLA", True, False), ("DENİZ", True, True), (None, None, None)], "token string, is_first boolean, is_surname boolean")
    df = spark.createDataFrame(rows, "tbl string, rec_key string, text string")
    return rows, {r.rec_key: r for r in personal.masked(df, names).collect()}, df, names


def test_every_form(done):
    rows, got, _, _ = done
    for _, key, text in rows[:60]:
        want = {("name", 7), ("identity", text.index("No: ") + 4), ("phone", text.index("0532")), ("address", text.index("Çınarlı")), ("name", text.index("Patolog ") + 8)}
        assert {(s.kind, s.start_at) for s in got[key].spans} == want
        assert "Gleason 7, deniz kenarında" in got[key].masked and "0532" not in got[key].masked and "[KIMLIK]" in got[key].masked


@pytest.mark.parametrize(
    ("key", "want"),
    [
        ("a", {("email", "ayla.boztepe"), ("name", "Ayla Boztepe"), ("phone", "0 532")}),
        ("b", set()),
        ("c", {("name", "Aуlа"), ("address", "Gül Caddesi")}),
        ("d", set()),
        ("e", set()),
        ("f", {("name", "C. Boztepe"), ("identity", "987 654")}),
    ],
)
def test_special(done, key, want):
    rows, got, _, _ = done
    text = next(t for _, k, t in rows if k == key)
    assert {(s.kind, s.start_at) for s in got[key].spans} == {(k, text.index(x)) for k, x in want}


def test_names_beyond_the_bound_come_by_a_join(done, monkeypatch):
    rows, got, df, names = done
    monkeypatch.setattr(personal, "NAMES_MOST", 3)
    again = {r.rec_key: (r.spans, r.masked) for r in personal.masked(df, names).collect()}
    assert again == {k: (r.spans, r.masked) for k, r in got.items()}
    assert {(r.rec_key, r.kind, r.start_at) for r in personal.found(personal.located(df, names)).collect()} == {(k, s.kind, s.start_at) for k, r in got.items() for s in r.spans}


def test_addresses_are_those_of_the_whole_pattern():
    rng = random.Random(2)
    parts = ["cinarli", "mah.", "mahallesi", "12.", "gul", "sok.", "caddesi", "no:", "4/5", "-", "\n", "daire 3", "tasova", "123456.", "sk", "a", ","]
    for _ in range(3_000):
        x = "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(1, 12)))
        assert [m.span() for m in personal.addresses(x)] == [m.span() for m in personal.ADDRESS.finditer(x)], repr(x)


def test_places_in_texts_with_ligatures():
    text = "ﬁlm\u200b о\u0308zel ﬃ"
    form, at = personal.normal(text)
    assert form == "film özel ffi" and len(form) == len(at) and [text[i] for i in at[:3]] == ["ﬁ", "ﬁ", "l"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(personal.KINDS), st.integers(0, 30), st.integers(1, 6), st.sampled_from([0.2, 0.9])), max_size=12))
def test_spans_do_not_overlap(some):
    spans = [(k, b, b + n, s) for k, b, n, s in some]
    got = personal.decided(spans)
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:], strict=False)) and all(s[3] >= 0.5 for s in got)
    assert all(s in got or any(s[1] < g[2] and g[1] < s[2] for g in got) for s in spans if s[3] >= 0.5)


def test_empty_tables(done):
    _, _, df, names = done
    assert personal.masked(df.limit(0), names).count() == 0
    assert personal.masked(df.filter("rec_key = '0'"), names.limit(0)).count() == 1


# -- 6: scanned pages
def page(i):
    return ["Örnek Bölge Hastanesi", "SONUÇ BELGESİ", f"Hasta {i}", "Gönderilen böbrek örneğinde belirgin tübül hücreleri izlendi ve", "kesitlerde düzensiz sınırlar dikkati çekti. Olguda genişlemiş", "damar duvarları saptandı."]


@pytest.fixture(scope="module")
def fixed(spark):
    rows = [(i, "\n".join(page(i)), None) for i in range(200)]
    odd = ["Örnek Bölge Hastanesi", "SONUÇ BELGESİ", "Gönderilen böbrek örneğ!nde belirgin tübül hüc-", "releri izlendi ve kcsitlerde düzensiz", "1", "\x0c", "Örnek Bölge Hastanesi Sayfa 2/2", "sınırlar dik¬", "kati çekti.", "PSA", "12", "Alerji -", "SONUÇ: yok"]
    rows += [(900, "\n".join(odd), "\n".join(odd[2:])), (901, None, ""), (902, "", None), (903, "x" * 100_000, None)]
    return scanned.repaired(spark.createDataFrame([(*r, 1) for r in rows], "ocr_id long, text string, alt_text string, marks int"))


def test_scanned(fixed):
    got = {(r.ocr_id, r.field): r for r in fixed.collect()}
    marks = {(m.kind, m.line_no) for m in got[900, "text"].marks}
    assert marks == {("hyphen", 2), ("misread", 2), ("misread", 3), ("page_no", 4), ("header", 6), ("hyphen", 7)}
    assert "örneğinde belirgin tübül hücreleri izlendi ve kesitlerde düzensiz sınırlar dikkati çekti." in got[900, "text"].repaired
    assert ("header", 4) in {(m.kind, m.line_no) for m in got[900, "alt_text"].marks}
    assert got[902, "text"].repaired == "" and (901, "text") not in got and got[901, "alt_text"].marks == []
    assert all(got[i, "text"].marks == [] for i in range(200)) and len(got[903, "text"].repaired) == 100_000


def test_the_bounds_of_what_is_sent_change_nothing(spark, small, monkeypatch):
    ocr = spark.read.parquet(f"{small}/ocr_result.parquet").select("ocr_id", "text", "alt_text").filter("ocr_id % 2 = 0")
    rows = lambda: sorted((r.ocr_id, r.field, r.repaired, str(r.marks)) for r in scanned.repaired(ocr).collect())
    want = rows()
    assert any("misread" in r[3] for r in want)
    monkeypatch.setattr(scanned, "WORDS", 30)
    monkeypatch.setattr(scanned, "PAIRS", 20)
    assert rows() == want


def test_key_and_readings():
    for seen, meant in scanned.CONFUSIONS:
        assert scanned.key_of(f"x{seen}x") == scanned.key_of(f"x{meant}x")
        assert ((seen, meant),) in scanned.readings(f"x{seen}x", f"x{meant}x")
    assert scanned.readings("k1t1lm1ş", "kıtılmış") == [(("1", "ı"), ("1", "ı"), ("1", "ı"))] and scanned.readings("abc", "abc") == []
    assert scanned.readings("1" * 30 + "x", "l" * 30 + "x") and not scanned.readings("cccx", "eeex") and len(scanned.readings("x" * 200_000 + "c", "x" * 200_000 + "e")) == 1
    assert scanned.placed("K1TAP", (("1", "i"),), "kitap") == [(1, 2, "İ")]


def test_words_that_may_be_others_are_all_met(spark):
    rng = random.Random(4)
    known = {"".join(rng.choice("aeılnmrui1c") for _ in range(rng.randrange(3, 7))): rng.randrange(1, 90) for _ in range(500)}
    info, _, _ = scanned.estimated(spark.createDataFrame(list(known.items()), "b string, n long"))
    got = {r.b: r for r in info.collect()}
    own = {w: r.own for w, r in got.items()}
    for w, n in known.items():
        ways = {v for v in known if v != w and any(c.isalpha() for c in w) and scanned.readings(w, v)}
        assert own[w] == (0 if any(known[v] > scanned.least_of(w, n) for v in ways) else n)
    for w in known:
        want = {v for v in known if v != w and own[v] >= 2 and scanned.readings(w, v)}
        assert {o.v for o in got[w].options or ()} == want
    bits = scanned.unsure(info)
    for w, r in got.items():
        c = zlib.crc32(w.encode()) % scanned.FILTER_BITS
        assert not r.options or bits[c >> 3] >> (c & 7) & 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ve", "kcsit", "örneğ!nde", "bir", "dcr1n", "kesit"]), min_size=1, max_size=9))
def test_a_stretch_is_decoded_as_in_its_line(line):
    n = {"ve": 50, "kesit": 40, "örneğinde": 30, "derin": 9, "bir": 20}
    info = {w: (k, k, []) for w, k in n.items()} | {"kcsit": (2, 2, [("kesit", 40, 40)]), "örneğ!nde": (1, 1, [("örneğinde", 30, 30)]), "dcr1n": (1, 1, [("derin", 9, 9)])}
    model = scanned.Model(info, {("ve", "kesit"): 9, ("kesit", "ve"): 3, ("derin", "kesit"): 2}, 200, scanned.letters_of(n.items()), dict.fromkeys(scanned.CONFUSIONS, 0.003))
    whole, at = model.decode(line), 0
    odd = [len(model.candidates(w)) > 1 for w in line]
    while at < len(line):
        end = at
        while end < len(line) and odd[end]:
            end += 1
        if end > at:
            begin = max(0, at - 1)
            some = ("" if begin else " ") + " ".join(line[begin : end + 1])
            if begin:  # the word before has one candidate, so where its line began does not matter
                assert model.decode(scanned.words_of(some))[1 : end - begin] == whole[at:end]
            else:
                assert model.decode(scanned.words_of(some))[at:end] == whole[at:end]
        at = end + 1


def test_heading_of_long_lines():
    assert scanned.heading_of("Baş " * 700 + "\nSONUÇ BELGESİ\nmetin")[1] == scanned.page_parts("x\nSONUÇ BELGESİ\nmetin")[2][1]
    assert scanned.heading_of("Baş\nSONUÇ\nmetin " * 900) == scanned.page_parts("Baş\nSONUÇ\nmetin")[2]
    assert scanned.heading_of("") is None and scanned.heading_of("tek satır") == scanned.page_parts("tek satır")[2]


def test_scanned_empty(spark):
    assert scanned.repaired(spark.createDataFrame([], "ocr_id long, text string, alt_text string")).count() == 0
