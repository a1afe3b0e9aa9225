"""The stages put together: mask, take what another reading shows, check, decide, let out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tahlil.operators import engine, gate, names, rules
from tahlil.session import written


def masked(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text", out: str = "masked") -> DataFrame:
    """`docs` with the text masked by the whole engine with the dictionary of names, to which the names of the labelled fields of
    all documents are added; names are then masked in medical sections too. Columns `out` and `fields_removed` of `docs` are replaced."""
    taught = written(names.learned(docs, text), "names")
    lexicon = lexicon.select("token", "is_first", "is_surname").unionByName(taught)
    keep = tuple(c for c in docs.columns if c not in (key, out, "fields_removed"))
    return engine.masked(docs, lexicon, key, text, out, everywhere=True, keep=keep)


def decided(docs: DataFrame, masked: str = "masked", other: str | None = None, candidates: str | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """`docs` with the `gate`, which also looks for the names of the `lexicon`, and the `decision`. What masking takes from another reading of the same page (`other`), and
    the `candidates` of a model, must not stand in the masked text."""
    none = F.array().cast("array<string>")
    known = F.coalesce(F.col(candidates), none) if candidates else none
    if other:
        docs = docs.withColumn("__other", rules.apply(F.col(other), [*rules.A1, *rules.A3, *rules.A4, *rules.A5_FULL, *rules.A8]))
        known = F.array_union(known, F.coalesce(gate.deleted_tokens(F.col(other), F.col("__other")), none))
    docs = gate.checked(docs.withColumn("__known", known), masked, "__known", lexicon=lexicon)
    return docs.withColumn("decision", gate.decision(F.col(masked), F.col("gate.passed"), F.col("__known"))).drop("__known", "__other")
