"""Units and terms on fresh examples."""

import pytest
from pyspark.sql import functions as F

from tahlil.functions import units as U
from tahlil.functions.terms import ADDED, Terms, distance
from tahlil.operators import quantities

TERMS = "term_id long, field string, term string, aliases array<string>"
QUANTITIES = "quantity_id long, quantity string, common_unit string, molar_mass double"
MARKERS = "marker_id long, ad string, deger string, kanit string, lab_code string"


@pytest.mark.parametrize(
    ("deger", "dims", "value", "unit"),
    [
        ("5,6 mg/dl", ("mass",), 5.6, "mg/dL"),
        ("12.345 ng/mL", ("mass",), 12345.0, "ng/mL"),
        ("7.399 ng/mL", ("mass",), 7.399, "ng/mL"),
        ("45 240 IU/L", ("activity",), 45240.0, "U/L"),
        ("1,02 10^9/L", ("count",), 1.02, "10^9/L"),
        ("1,02x10^10/L", ("count",), 1.02e10, "/L"),
        ("5.82 x 10^11", ("count",), 5.82e11, None),
        ("3 G/L", ("count",), 3.0, "10^9/L"),
        ("3 g/L", ("mass",), 3.0, "g/L"),
        ("%12,5 H", ("part",), 12.5, "%"),
        ("binde 40", ("part",), 40.0, "binde"),
        ("0,4 (0-1 arası)", ("part",), 0.4, "oran"),
        ("yirmi üç mm", ("length",), 23.0, "mm"),
        ("7 mM", ("mass", "amount"), 7.0, "mmol/L"),
        ("3 ug/L", ("mass",), 3.0, "µg/L"),
        ("3" + " " * 90 + "u" + " " * 50 + "g/L", ("mass",), 3.0, "µg/L"),
        ("yüzde" + " " * 60 + "12", ("part",), 12.0, "%"),
    ],
)
def test_numbers_and_units(deger, dims, value, unit):
    (_, _, got, k), *_ = U.numbers(U.plain_text(deger), dims)
    assert got == pytest.approx(value) and (U.UNITS[k][0] if k >= 0 else None) == unit


def test_sizes_share_a_unit():
    assert quantities.reading("Tümör çapı", "1,2 x 3 x 0.5 cm", None, ("length",)) == (next(i for i, u in enumerate(U.UNITS) if u[0] == "cm"), [1.2, 3.0, 0.5])


def test_factors():
    at = {u[0]: i for i, u in enumerate(U.UNITS)}
    assert U.factor(at["µmol/L"], at["mg/dL"], 113.12) == pytest.approx(0.011312)
    assert U.factor(at["µkat/L"], at["U/L"], None) == 60
    assert U.factor(at["mm"], at["U/L"], None) is None


@pytest.fixture
def tables(spark):
    terms = spark.createDataFrame([(1, "ad", "Kreatinin", []), (2, "ad", "LDH", ["Laktat dehidrogenaz"])], TERMS)
    quantity = spark.createDataFrame([(1, "Kreatinin", "mg/dL", 113.12), (2, "LDH", "U/L", None)], QUANTITIES)
    source = spark.createDataFrame([("L1", 1, "µmol/L"), ("L1", 1, "µmol/L"), ("L1", 2, "U/L")], "lab_code string, quantity_id long, unit string")
    return terms, quantity, source


def test_converted(spark, tables):
    rows = [
        (1, "kreatinin", "88,4 µmol/L", None, None),
        (2, "KREATNİN (mg/dl)", "1,1", None, "L1"),
        (3, "Kreatinin", "90", "", "L1"),
        (4, "Kreatinin", "1,2", "düzeyi 1,2 mg/dL bulundu", "L1"),
        (5, "LDH", "3 µkat/L", None, "L1"),
        (6, "LDH", "200", None, None),
        (7, None, "5", None, "L1"),
        (8, "LDH", None, None, "L1"),
        (9, "Başka", "5 mg/dL", None, "L1"),
        (10, "LDH", "pozitif", None, "L1"),
        (11, "LDH", "", "", "L1"),
        (12, "LDH", "200", None, "L1"),
        (12, "LDH", "200", None, "L1"),
    ]
    markers = spark.createDataFrame(rows, MARKERS).selectExpr("*", "1 as unit", "2 as written")
    got = quantities.converted(markers, *tables)
    value = {r.marker_id: r.value for r in got.collect()}
    assert value[1] == pytest.approx(1.0, rel=1e-3) and value[2] == 1.1 and value[3] == pytest.approx(1.018, rel=1e-3)
    assert value[4] == 1.2 and value[5] == 180 and value[6] is None and set(value) == {1, 2, 3, 4, 5, 6, 12}
    assert sorted(r.marker_id for r in quantities.differing(got).collect()) == [1, 3, 5]
    assert quantities.converted(markers.limit(0), *tables).count() == 0


def test_nulls_in_reference_tables(spark):
    terms = spark.createDataFrame([(1, "ad", "LDH", [None, ""]), (None, "ad", "X", None), (2, "ad", None, None), (3, None, "Y", None)], TERMS)
    quantity = spark.createDataFrame([(2, "LDH", "U/L", None), (None, "LDH", "U/L", None), (3, None, "U/L", None), (4, "Y", "elma", None), (5, "Y", None, None)], QUANTITIES)
    source = spark.createDataFrame([(None, 2, "U/L"), ("L1", None, "U/L"), ("L1", 2, None)], "lab_code string, quantity_id long, unit string")
    markers = spark.createDataFrame([(None, "LDH", "5 kU/L", None, None), (1, "LDH", "5", None, "L1")], MARKERS)
    assert {(r.marker_id, r.value) for r in quantities.converted(markers, terms, quantity, source).collect()} == {(None, 5000.0), (1, None)}


def test_terms():
    t = Terms([(1, "Lenf düğümü", ["Lenf nodu"], 5), (2, "CD3", [], 1), (3, "CD30", [], 1), (4, "Skuamöz hücreli karsinom", ["SCC"], 1)], ADDED | {"sag", "grade"})
    for typed, want in (("LENF NODU", 1), ("sağ Lenf düğümünda", 1), ("lenf dügmü", 1), ("C-D3", 2), ("CD3O", 3), ("karsinom Skuamöz hücreli, grade 2", 4), ("S.CC", 4), ("CD4", 0), ("", 0), ("???", 0)):
        assert t.match(typed)[0] == want, typed
    assert distance("kitap", "kiatp", 2) == 1 and distance("cd3", "cd4", 2) == float("inf") and distance("kitaap", "kitap", 1) == 0.8


def test_list_too_long_is_refused():
    with pytest.raises(ValueError, match="forms"):
        Terms([(i, f"t{i}", [], 0) for i in range(30_000)])


def test_a_large_table_of_laboratories(spark, tables, monkeypatch):
    markers = spark.createDataFrame([(i, "Kreatinin" if i % 2 else "LDH", str(50 + i), None, "L1" if i % 5 else None) for i in range(200)], MARKERS)
    rows = lambda: sorted((r.marker_id, r.value, r.unit_name) for r in quantities.converted(markers, *tables).select("marker_id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("unit_name", F.lit("")).alias("unit_name")).collect())
    want = rows()
    monkeypatch.setattr(quantities, "SENT_ROWS", 1)
    assert rows() == want and len(want) == 200
    monkeypatch.setattr(quantities, "LIST_MOST", 1)
    with pytest.raises(ValueError):
        rows()
