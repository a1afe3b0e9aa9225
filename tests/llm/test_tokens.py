"""Token ids against the tokenizer itself, and back."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tahlil.llm import tokens

PATH = tokens.tokenizer_path()
ODD = ["don't 's I'll ''s  'd \n\t x'", "", "  ", "a  b \n\n c d　e ", "'stuff we'rex 'll'm’s it's've", "数字123 ½ x²​\r\n\r\n  end  ", "<|endoftext|> a<|endoftext|>b", "x" * 5_000, "\x85 a", "'s", " '", "'"]


def want(texts):
    return [e.ids for e in tokens.tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def got(texts):
    none = pa.table({"word": pa.array(["a", " the"]), "ids": tokens.encode_words(["a", " the"], PATH)})
    return tokens.ids_of(pa.array(texts, pa.string()), tokens.Known(none), PATH).to_pylist()


def test_kept_words(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    known = tokens.Known(pa.table({"word": pa.array(["a"]), "ids": tokens.encode_words(["a"], PATH)}))
    for i in range(90):
        texts = [f"a kelime{i} x{i % 7}", "a", None, f"x{i % 3} x{i % 3}"]
        assert tokens.ids_of(pa.array(texts, pa.string()), known, PATH).to_pylist() == want(texts)


def test_odd_texts():
    assert got([*ODD, None]) == want([*ODD, None])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'sdtlrvem \n\t1½.-ışé🚀 　"), max_size=20), min_size=1, max_size=6))
def test_any_texts(texts):
    assert got(texts) == want(texts)


def test_encode_and_decode(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, ODD[0], ODD[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    enc = tokens.encode(df)
    assert {r.doc_id: r.ids for r in enc.collect()} == dict(enumerate(want([t for _, t, _ in rows])))
    assert {r.doc_id: r.text for r in tokens.decode(enc).collect()} == {i: t or "" for i, t, _ in rows}
    assert tokens.encode(df.limit(0)).count() == 0


def test_slices_cover_everything(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 10)
    a = pa.array(["abc", None, "", "x" * 50, "y"])
    assert [x for s in tokens.slices(a) for x in s.to_pylist()] == a.to_pylist()


def test_words_outside_the_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"ortak kelime {i} tek{i}") for i in range(40)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(tokens, "TABLE_WORDS", 2)
    small = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert small == dict(enumerate(want([f"ortak kelime {i} tek{i}" for i in range(40)])))


@pytest.mark.parametrize("name", ["p7_ids"])
def test_query(spark, small, name):
    from tahlil.llm.queries import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in queries()[name](spark, small).collect()}
    assert ids == dict(zip(docs, want(docs.values()), strict=True))
