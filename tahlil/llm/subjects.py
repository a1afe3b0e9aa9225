"""Problem 9: the subjects of each notebook, by a seeded factorisation of the document-term matrix.

A row of the matrix is one text cell, or the data of one notebook (the names its code uses); a column is a
term, weighted by the inverse root of its rows. Components are anchored: one for each subject and language
(names of code count as a language), seeded with the terms that the labelled sample ties to the subject, and
some for what all notebooks of a language share. Alternating non-negative updates over all rows fit the components;
the mixture of a row then gives its subject directly.

Vocabulary, label counts and every update cover all rows. The columns of the matrix are the TERMS terms of most rows; what
comes to the driver is bounded by TERMS times the number of components, whatever the corpus. A row of rarer terms only
stays in the matrix, with an empty mixture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tahlil.functions.frequent import chosen
from tahlil.session import written

TERMS = 20_000  # most terms of the matrix, by number of rows
LEAST_ROWS = 5  # fewest rows of a term
SHARED = 2  # components of each language for what is common to all subjects
SEED_SHARE, SMOOTH = 0.5, 2.0  # share of a subject among a term's labels that makes it a seed, and its smoothing
SURE = 1.64  # deviations by which the share of a term must be under it, for the term to be common to all
PASSES, STEPS = 4, 12  # updates of the components over all rows; steps for the mixture of a row
LEAST_SHARE = 0.07  # of a row's mixture that a subject must have
WORD = re.compile(r"[^\W\d_]{2,}")
NAME = re.compile(r"(?<![^\W_])[a-z][a-z]*(?:_[a-z]+)*", re.IGNORECASE)
DATA = -1  # cell number of the row of a notebook's data
CODE = "code"  # the language of the names of code
SUBJECTS_MOST = 200  # most subjects
MIXED = "doc_id long, cell_no int, prose boolean, subject string, share double, shares array<double>"
ROWS = "doc_id long, lang string, cell_no int, prose boolean, terms array<string>"


def rows(docs: DataFrame) -> DataFrame:
    """The rows of the matrix: doc_id, cell_no (DATA for the data of the notebook), whether the notebook has prose,
    and the distinct terms; names of code carry a mark before them. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, cells, langs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = cells.flatten()
            kind = pc.fill_null(flat.field("cell_type"), "").to_pylist()
            begin, size, number = (pc.fill_null(flat.field(f), 0).to_pylist() for f in ("begin_at", "n_chars", "cell_no"))
            out: tuple[list, ...] = ([], [], [], [], [])
            for d, text, lang, i, j in zip(ids, texts, langs, ends[:-1], ends[1:], strict=True):
                if not text:
                    continue
                names: set[str] = set()
                prose = []
                for k in range(i, j):
                    if kind[k] == "text":
                        prose.append((number[k], {w for w in WORD.findall(text[begin[k] : begin[k] + size[k]].lower())}))
                    elif kind[k] == "code":
                        names.update(NAME.findall(text[begin[k] : begin[k] + size[k]]))
                told = any(w for _, w in prose)
                for no, words in [*prose, (DATA, {f"={n.lower()}" for n in names if len(n) > 1})]:
                    if words:
                        for column, x in zip(out, (d, CODE if no == DATA else lang or "", no, told, sorted(words)), strict=True):
                            column.append(x)
            types = (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "lang", "cell_no", "prose", "terms"])

    return docs.filter("text is not null and text <> ''").select("doc_id", "text", "cells", "lang").mapInArrow(run, ROWS)


def vocabulary(matrix: DataFrame) -> dict[str, tuple[int, str]]:
    """The terms of the matrix with their number of rows and the language of most of these: the most frequent
    terms, as many as the bound allows."""
    by = matrix.select(F.explode("terms").alias("term"), "lang").groupBy("term", "lang").agg(F.count(F.lit(1)).alias("k"))
    counts = by.groupBy("term").agg(F.sum("k").alias("n"), F.max_by("lang", F.struct("k", "lang")).alias("lang")).filter(F.col("n") >= LEAST_ROWS)
    counts = written(counts, "terms")
    return {r.term: (r.n, r.lang) for r in counts.filter(chosen(counts, "n", TERMS, "term")).collect()}


def label_counts(coded: DataFrame, labels: DataFrame, known: list[str]) -> list:
    """(place, subject, n): labelled rows with each term of the matrix, a notebook of several labels counting in parts."""
    one = labels.filter(F.col("subject").isin(known)).groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("votes"))
    parts = one.join(one.groupBy("doc_id").agg(F.sum("votes").alias("all")), "doc_id").select("doc_id", "subject", (F.col("votes") / F.col("all")).alias("part"))
    return coded.join(parts, "doc_id").select(F.explode("places").alias("place"), "subject", "part").groupBy("place", "subject").agg(F.sum("part").alias("n")).collect()


def languages(terms: dict[str, tuple[int, str]]) -> list[str]:
    """The languages of at least a hundredth of the terms; the others go with the first."""
    seen: dict[str, int] = {}
    for _, lang in terms.values():
        seen[lang] = seen.get(lang, 0) + 1
    return sorted((x for x, n in seen.items() if n * 100 >= len(terms)), key=lambda x: (-seen[x], x))


def start(terms: dict[str, tuple[int, str]], counted: list, subjects: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components before the first update (those of subjects first), the subject of each (-1: shared), and the
    weights of the terms."""
    df = np.array([terms[t][0] for t in sorted(terms)], float)
    tongues = languages(terms)
    tongue = np.array([tongues.index(terms[t][1]) if terms[t][1] in tongues else 0 for t in sorted(terms)])
    n = np.zeros((len(subjects), len(terms)))
    for r in counted:
        n[subjects.index(r.subject), r.place] += r.n
    # every label weighs the same, however many rows have it
    total = n.sum(1, keepdims=True)
    n = n * np.where(total > 0, total.sum() / (len(subjects) * np.maximum(total, 1e-9)), 0)
    share = (n + SMOOTH / len(subjects)) / (n.sum(0) + SMOOTH)
    seed = (share == share.max(0)) & (share >= SEED_SHARE) & (n.sum(0) >= 2)
    # a term that surely belongs to no subject stays out of their components
    top = share.max(0)
    common_word = top + np.sqrt(top * (1 - top) / np.maximum(n.sum(0), 0.5)) * SURE < SEED_SHARE
    weight = 1 / np.sqrt(df)
    rng, h, of = np.random.default_rng(11), [], []
    for k in range(len(subjects)):
        for x in range(len(tongues)):
            own = tongue == x
            if (seed[k] & own).any():
                h.append(np.where(seed[k] & own, share[k], np.where(common_word, 0.0, np.where(own, 1e-3, 1e-5))) * df * weight)
                of.append(k)
    for x in range(len(tongues)):
        for _ in range(SHARED):
            h.append(np.where(seed.any(0), 1e-3, np.where(tongue == x, 1.0, 1e-3)) * df * weight * (0.5 + rng.random(len(terms))))
            of.append(-1)
    h = np.array(h)
    return h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12), np.array(of), weight


def mixtures(h: np.ndarray, weight: np.ndarray, columns: np.ndarray, ends: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The mixture of each row (scaled to unit length) over the components; and its entries."""
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    value = weight[columns]
    value = value / np.sqrt(np.maximum(np.bincount(row, value * value, len(size)), 1e-12))[row]
    xh = np.add.reduceat(np.vstack([h.T[columns] * value[:, None], np.zeros((1, len(h)))]), np.minimum(ends[:-1], len(columns)), axis=0)
    xh[size == 0] = 0
    gram = h @ h.T
    w = np.maximum(xh, 1e-9)
    for _ in range(steps):
        w *= xh / np.maximum(w @ gram, 1e-12)
    return w, value


def shares(h: np.ndarray, of: np.ndarray, w: np.ndarray, subjects: int) -> np.ndarray:
    """The share of each subject in the mixtures."""
    part = w * h.sum(1)
    by = np.stack([part[:, of == k].sum(1) for k in range(subjects)], 1)
    return by / np.maximum(part.sum(1, keepdims=True), 1e-12)


def encoded(matrix: DataFrame, terms: dict[str, int]) -> DataFrame:
    """The rows with the places of their terms instead of the terms; a row without any has an empty list."""
    held = matrix.sparkSession.sparkContext.broadcast(sorted(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.string())
        for b in batches:
            lists = b.column(3)
            flat = pc.index_in(lists.flatten(), value_set=known)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            there = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[there], minlength=len(lists)))]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(there)).cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], places], names=["doc_id", "cell_no", "prose", "places"])

    return matrix.select("doc_id", "cell_no", "prose", "terms").mapInArrow(run, "doc_id long, cell_no int, prose boolean, places array<int>")


def fitted(coded: DataFrame, h: np.ndarray, weight: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """The components after updates over all rows. Each task adds up its rows; the sums by term are grouped before
    they come to the driver."""
    spark, k = coded.sparkSession, len(h)
    fields = ", ".join(f"c{i} double" for i in range(k))
    for _ in range(passes):
        held = spark.sparkContext.broadcast((h, weight))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            h, weight = held.value
            wx, ww = np.zeros((h.shape[1], len(h))), np.zeros((len(h), len(h)))
            for b in batches:
                columns, ends = parts(b.column(0))
                w, value = mixtures(h, weight, columns, ends)
                row = np.repeat(np.arange(len(w)), np.diff(ends))
                for i in range(len(h)):
                    wx[:, i] += np.bincount(columns, w[row, i] * value, h.shape[1])
                ww += w.T @ w
            met = np.flatnonzero(wx.any(1))
            place = np.concatenate([met, -1 - np.arange(len(h))]).astype(np.int32)
            sums = np.vstack([wx[met], ww])
            yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(sums[:, i]) for i in range(len(h)))], names=["place", *(f"c{i}" for i in range(len(h)))])

        got = coded.select("places").mapInArrow(run, f"place int, {fields}").groupBy("place").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k))).toPandas()
        sums = got.drop(columns="place").to_numpy()
        wx, ww = np.zeros((k, h.shape[1])), np.zeros((k, k))
        at = got.place.to_numpy()
        wx[:, at[at >= 0]] = sums[at >= 0].T
        ww[-1 - at[at < 0]] = sums[at < 0]
        h = h * wx / np.maximum(ww @ h, 1e-12)
        h = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    return h


def parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a list array, and the place where each list begins (with the end)."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends


def known_subjects(areas: DataFrame) -> list[str]:
    """The subjects of the fixed list, sorted; refused beyond SUBJECTS_MOST."""
    got = [r.subject for r in areas.select("subject").filter("subject is not null and subject <> ''").distinct().limit(SUBJECTS_MOST + 1).collect()]
    if len(got) > SUBJECTS_MOST:
        raise ValueError(f"there are more than {SUBJECTS_MOST} subjects")
    return sorted(got)


def mixed(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """The subject mixture of every row: doc_id, cell_no, prose, the best `subject`, its `share` of the row's
    mixture, and the `shares` of all subjects in order of their names.

    `areas`: subject (a fixed list of at most SUBJECTS_MOST). Labels of unknown subjects don't count. Without documents or labels
    there are no rows. Repeated documents give repeated rows.
    """
    spark = docs.sparkSession
    subjects = known_subjects(areas)
    matrix = written(rows(docs), "subject-rows")
    terms = vocabulary(matrix)
    coded = written(encoded(matrix, terms), "subject-matrix")
    counted = label_counts(coded, labels, subjects)
    if not terms or not counted:
        return spark.createDataFrame([], MIXED)
    h, of, weight = start(terms, counted, subjects)
    held = spark.sparkContext.broadcast((fitted(coded, h, weight), of, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, of, weight = held.value
        for b in batches:
            w, _ = mixtures(h, weight, *parts(b.column(3)))
            share = shares(h, of, w, len(subjects))
            best = share.argmax(1)
            every = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * len(subjects)), pa.array(share.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([subjects[i] for i in best], pa.string()), pa.array(share[np.arange(len(best)), best]), every],
                names=["doc_id", "cell_no", "prose", "subject", "share", "shares"],
            )

    return coded.mapInArrow(run, MIXED)


def counting() -> Column:
    """Whether a row says what its notebook is about: a text cell, or the data of a notebook without prose."""
    return (F.col("cell_no") != DATA) | ~F.col("prose")


def mixture_of_documents(mix: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, `mixture`): the subjects of each notebook with their shares, greatest first, that is the mean mixture of its rows
    that count, scaled to 1. A notebook in which no subject has any share has an empty mixture. Rows of one doc_id
    are one notebook."""
    subjects = known_subjects(areas)
    sums = mix.filter(counting()).groupBy("doc_id").agg(*(F.sum(F.get("shares", F.lit(i))).alias(f"s{i}") for i in range(len(subjects))))
    total = sum((F.col(f"s{i}") for i in range(len(subjects))), F.lit(0.0))
    each = F.array(*(F.struct((F.col(f"s{i}") / total).alias("share"), F.lit(s).alias("subject")) for i, s in enumerate(subjects)))
    some = F.sort_array(F.filter(each, lambda x: x["share"] > 0), asc=False)
    return sums.select("doc_id", F.when(total > 0, F.transform(some, lambda x: F.struct(x["subject"].alias("subject"), x["share"].alias("share")))).otherwise(F.array().cast("array<struct<subject:string,share:double>>")).alias("mixture"))


def found(mix: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject) for each subject that a whole text cell is about, or the data of a notebook without prose."""
    return mix.filter(counting() & (F.col("share") >= least)).select("doc_id", "subject").distinct()


def composition(mix: DataFrame, docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """How many notebooks of each source are about each subject."""
    by = found(mix, least).join(docs.select("doc_id", "source").distinct(), "doc_id")
    return by.groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n_docs"))
