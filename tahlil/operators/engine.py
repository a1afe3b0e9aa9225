"""The masking engine: all layers in their order, with those between them that are no rules: misread provinces behind the
institutions (A7), and the dictionary of names (A11) before the last numbers and the cleaning up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tahlil.operators import names, rules
from tahlil.session import written

PLACES_AT, NAMES_AT = rules.ORDER.index("a07") + 1, rules.ORDER.index("a10") + 1


def masked(df: DataFrame, lexicon: DataFrame, key: str, text: str = "text", out: str = "masked", everywhere: bool = False, remove_institutions: bool = True, keep: tuple[str, ...] = (), **flags) -> DataFrame:
    """(key, `out`, `fields_removed`, and the columns to keep): each text through the whole engine. Names are left in medical
    sections unless `everywhere`; the flags are those of `rules.masked`. Columns to keep go along, so no join has to
    bring them back."""
    flags["remove_institutions"] = remove_institutions

    def layers(d: DataFrame, some: tuple[str, ...]) -> DataFrame:
        before = d.withColumnRenamed("fields_removed", "__before")
        return rules.masked(before, "__text", "__text", layers=some, **flags).withColumn("fields_removed", F.array_union("__before", "fields_removed")).drop("__before")

    d = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.array().cast("array<string>").alias("fields_removed"), *(F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)))
    d = layers(d, rules.ORDER[:PLACES_AT])
    if remove_institutions:
        d = names.mask_misread_places(d, "__text", "fields_removed")
    d = written(layers(d, rules.ORDER[PLACES_AT:NAMES_AT]), "masked")
    d = names.mask_all_names(d, lexicon, "__key", "__text", "fields_removed", everywhere)
    d = layers(d, rules.ORDER[NAMES_AT:])
    return d.select(F.col("__key").alias(key), F.col("__text").alias(out), "fields_removed", *(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)))
