"""Problem 2: freely typed values mapped to the entries of a reference list, and a report of the misses.

The list (a checked, bounded size) is broadcast, and each worker makes the symmetric-delete dictionary of it once; a value is looked
up by its own deletions within a bounded edit distance, and the candidates are ranked by weighted
Damerau-Levenshtein distance, then by how often the entry is written letter for letter in the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tahlil.functions.terms import ADDED as SPECIMEN
from tahlil.functions.terms import FORMS_MOST, Terms
from tahlil.session import made

# Words added to a term that do not change which entry is meant, folded (fixed values).
SIDES = "sag sol bilateral iki tarafli taraf sagda solda"
PARTS = "alt ust orta arka on ic dis kesim bolum bolumu parca kismi yari kutup lob lobu bolgesi"
STATE = "olasi muhtemel suphesi uyumlu iyi orta az kotu diferansiye grade derece evre"
ADDED = SPECIMEN | frozenset(f"{SIDES} {PARTS} {STATE}".split())
MAPPED = "field string, rec_id long, value string, term_id long, cost double"


def values(markers: DataFrame, reports: DataFrame) -> DataFrame:
    """(field, rec_id, value) of the typed fields; null values are left out."""
    parts = [(markers, "ad", "marker_id"), (reports, "histolojik_tip", "report_id"), (reports, "primer_bolge", "report_id")]
    out = [df.filter(F.col(f).isNotNull()).select(F.lit(f).alias("field"), F.col(key).cast("long").alias("rec_id"), F.col(f).alias("value")) for df, f, key in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def listed(terms: DataFrame) -> list:
    """The usable entries of the reference list: those with id, field and term. A list with more than FORMS_MOST entries is
    refused before anything of it is read."""
    if (n := terms.count()) > FORMS_MOST:
        raise ValueError(f"the reference list has {n} rows; at most {FORMS_MOST} are sent to the executors")
    return terms.filter("term_id is not null and field is not null and term is not null").select("term_id", "field", "term", "aliases").collect()


def mapped(typed: DataFrame, terms: DataFrame) -> DataFrame:
    """The entry each value stands for: `term_id` (0 if none) and the `cost` of the way there (-1 if none).

    A value that is a term letter for letter costs 0. An empty value, and one of a field without entries, is
    a miss. Ties go to the more frequent entry, then to the smaller id. Repeated rows stay repeated.
    """
    rows = listed(terms)
    exact = F.broadcast(terms.select("field", F.col("term").alias("value")).distinct())  # at most FORMS_MOST rows, or `listed` has refused
    seen = {(r.field, r.value): r.n for r in typed.join(exact, ["field", "value"], "left_semi").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_field: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.term_id):
        by_field.setdefault(r.field, []).append((r.term_id, r.term, list(r.aliases or []), seen.get((r.field, r.term), 0)))
    sent = typed.sparkSession.sparkContext.broadcast(by_field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = made(sent, lambda x: {f: Terms(e, ADDED) for f, e in x.items()})
        for b in batches:
            got = [index[f].match(v) if f in index else (0, -1.0) for f, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            ids, cost = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64()), pa.array(cost, pa.float64())], names=["field", "rec_id", "value", "term_id", "cost"])

    return typed.select("field", "rec_id", "value").mapInArrow(run, MAPPED)


def found(mapping: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, rec_id, term_id) of the values that are not letter for letter a term of their field. `terms` is the list that
    `mapped` has checked."""
    exact = F.broadcast(terms.select("field", F.col("term").alias("value")).distinct())
    return mapping.join(exact, ["field", "value"], "left_anti").select("field", "rec_id", "term_id")


def misses(mapping: DataFrame) -> DataFrame:
    """The values that stand for no entry, with how often each was typed."""
    return mapping.filter("term_id = 0").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
