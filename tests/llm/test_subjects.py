"""Subjects: held-out accuracy on made-up notebooks with known subjects and some wrong labels."""

import random

import pytest

from tahlil.llm import subjects

WORDS = {"law": ["verdict", "statute", "appeal", "plaintiff"], "food": ["flour", "yeast", "butter", "oven"], "sport": ["goal", "referee", "sprint", "league"]}
SHARED = "we first look at the rows about and how it relates to the plot below for each week".split()
CELL = "struct<cell_no:int,cell_type:string,exec_no:int,begin_at:int,n_chars:int>"


def notebook(rng, about, prose=True):
    text, cells = "", []

    def cell(kind, body):
        nonlocal text
        cells.append((len(cells), kind, None, len(text), len(body)))
        text += body + "\n\n"

    cell("code", "import numpy as np\nframe = 1")
    for s in about:
        if prose:
            words = rng.sample(SHARED, 9) + rng.sample(WORDS[s], 2)
            rng.shuffle(words)
            cell("text", " ".join(words))
        cell("code", f"data['{rng.choice(WORDS[s])}_no'].mean()")
    if prose:
        cell("text", "run the cells from top to bottom")
    return text, cells


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs, labels, truth = [], [], {}
    for i in range(600):
        about = rng.sample(list(WORDS), rng.choice((1, 1, 2)))
        docs.append((i, *notebook(rng, about, i % 9 > 0), "en", "s", 1))
        truth[i] = set(about)
        if i < 240:
            labels += [(i, s if rng.random() > 0.08 else rng.choice(list(WORDS)), "a") for s in about]
    docs += [(900, None, None, None, None, 1), (901, "", [], "en", None, 1), (902, "run the cells from top to bottom", [(0, "text", None, 0, 32)], None, "s", 1)]
    labels.append((5, "unknown", "b"))
    d = spark.createDataFrame(docs, f"doc_id long, text string, cells array<{CELL}>, lang string, source string, share int")
    return d, spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), spark.createDataFrame([(s,) for s in WORDS], "subject string"), truth


def test_held_out(corpus):
    docs, labels, areas, truth = corpus
    got = {(r.doc_id, r.subject) for r in subjects.found(subjects.mixed(docs, labels, areas)).collect()}
    want = {(i, s) for i, a in truth.items() for s in a if i >= 240}
    some = {x for x in got if x[0] >= 240}
    assert len(some & want) > 0.95 * len(want) and len(some - want) < 0.05 * len(want)
    assert not {x for x in got if x[0] >= 900}


def test_nothing(corpus):
    docs, labels, areas, _ = corpus
    assert subjects.mixed(docs.limit(0), labels, areas).count() == 0
    assert subjects.mixed(docs, labels.limit(0), areas).count() == 0


def test_mixture_of_documents(corpus):
    docs, labels, areas, truth = corpus
    got = {r.doc_id: {m.subject: m.share for m in r.mixture} for r in subjects.mixture_of_documents(subjects.mixed(docs, labels, areas), areas).collect()}
    assert 900 not in got and 901 not in got and 902 in got and set(truth) <= set(got)
    assert all(not m or abs(sum(m.values()) - 1) < 1e-9 for m in got.values())
    two = [i for i, a in truth.items() if len(a) == 2 and i >= 240]
    top = [set(sorted(got[i], key=got[i].get, reverse=True)[:2]) == truth[i] for i in two]
    assert sum(top) > 0.9 * len(top) and all(len(got[i]) > 1 for i in two)


def test_terms_beyond_the_bound(corpus, monkeypatch):
    docs, labels, areas, _ = corpus
    monkeypatch.setattr(subjects, "TERMS", 12)
    mix = subjects.mixed(docs, labels, areas)
    assert {r.doc_id for r in mix.select("doc_id").distinct().collect()} >= set(range(600))  # no row is lost with its terms
    monkeypatch.setattr(subjects, "SUBJECTS_MOST", 2)
    with pytest.raises(ValueError):
        subjects.mixed(docs, labels, areas)
