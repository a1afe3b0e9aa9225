"""Masking by spans: what a model finds and what rules find together, medical words left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tahlil.functions.patterns import Rule
from tahlil.operators import models, rules, spans
from tahlil.operators.gate import looks_medical

#: Rules whose matches are spans, with the label of each.
RULES: tuple[tuple[str, list[Rule]], ...] = (
    ("national id", rules.A1),
    ("reference", rules.A2),
    ("date", rules.A5_FULL),
    ("phone number", [r for r in rules.A8 if r.name == "Telefon/Faks"]),
    ("email", [r for r in rules.A8 if r.name == "E-posta"]),
    ("url", [r for r in rules.A8 if r.name == "Web"]),
    ("person", [*rules.A3, *rules.A4]),
    ("diploma", rules.A9),
)
SURE = 0.95


def rule_spans(df: DataFrame, text: str, out: str = "rule_spans") -> DataFrame:
    """`df` with the places at which the rules match, each with its label and a fixed score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [(label, regex.compile(r.java())) for label, some in RULES for r in some]
        for f in frames:
            rows = [[{"start": m.start(), "end": m.end(), "text": m.group(), "label": label, "score": SURE} for label, p in made for m in p.finditer(t) if m.group()] if t else [] for t in f[text]]
            yield f.drop(columns=out, errors="ignore").assign(**{out: rows})

    return df.drop(out).mapInPandas(run, models.extended(df, out, models.SPANS))


def masked(df: DataFrame, text: str, make: Callable, out: str = "masked") -> DataFrame:
    """`df` with the masked text: model and rule spans together, those of the model that are medical words left out,
    overlaps merged, each replaced by the tag of its label; three tags in a row or more become one. Null stays null."""
    both = rule_spans(models.entities(df, text, make, out="__model"), text, "__rule")
    kept = F.filter("__model", lambda s: ~looks_medical(s["text"]))
    done = spans.overlaid(F.col(text), spans.merged(F.concat(kept, F.col("__rule"))))
    tidy = F.regexp_replace(F.regexp_replace(done, "(?:\\[[A-Za-z_]+_SILINDI\\][ \\t\\n]*){3,}", "[COKLU_ALAN_SILINDI]\n"), "\n{4,}", "\n\n")
    return both.withColumn(out, tidy).drop("__model", "__rule")
