"""Counts and measures over logs and over readings compared with the truth."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tahlil.functions.turkish import ascii_fold, fold


def normal(text: Column) -> Column:
    """Folded, one blank for blanks and line ends, none at both ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), "[ \\t]+", " "), "[ ]*\\n[\\n ]*", " "))


def error_rate(truth: Column, read: Column) -> Column:
    """Character error rate: edit distance by the length of the truth, to four places."""
    a, b = normal(truth), normal(read)
    return F.bround(F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a)), 4)


CELLS = 4_096  # cells of a group's values, in the search for its middle


def upper_median(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The value in the middle of each group, the upper one of two, without gathering or sorting the group: its place is looked for
    among the counts of cells of the value, which are at most CELLS a group, and then within the one cell that holds it. Ties in a
    cell are one value with a count. A group of any size is pre-aggregated by cell, and only one cell of it is sorted."""
    values = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    span = values.groupBy(*by).agg(F.min(x).cast("double").alias("__low"), F.max(x).cast("double").alias("__high"), F.sum("n").alias("__all"))
    v, g = values.alias("v"), span.alias("g")
    width = F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-300))
    cell = F.floor((F.col(f"v.{x}").cast("double") - F.col("__low")) / width * CELLS)
    placed = v.join(g, reduce(lambda p, q: p & q, (F.col(f"v.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by), F.lit(True))).select("v.*", "__all", cell.alias("__cell"))
    cells = placed.groupBy(*by, "__cell").agg(F.sum("n").alias("__n"), F.first("__all").alias("__all"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__cell"))
    middle = F.floor(F.col("__all") / 2)
    at = cells.withColumn("__before", upto - F.col("__n")).filter((F.col("__before") <= middle) & (F.col("__before") + F.col("__n") > middle)).select(*by, "__cell", "__before").alias("c")
    p = placed.alias("p")
    inside = p.join(at, reduce(lambda a, b: a & b, (F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "__cell"]))).select("p.*", "__before")
    here = F.col("__before") + F.sum("n").over(Window.partitionBy(*by).orderBy(x))
    return inside.withColumn("__upto", here).filter((F.col("__upto") > middle) & (F.col("__upto") - F.col("n") <= middle)).select(*by, F.col(x).alias(f"{x}_median"))


def rate(part: Column, whole: Column, places: int = 3) -> Column:
    """The sum of one by the sum of the other (1 at least)."""
    return F.bround(F.sum(part) / F.greatest(F.lit(1), F.sum(whole)), places)


def alike(hay: str, needle: str, least: float) -> bool:
    """Whether a part of the hay, of the needle's length or two more or less, is as similar to it as `least` (twice the matching
    characters by those of both).

    A window slides over the hay with the number of characters that it has in common with the needle, whatever their order;
    only where these could be enough the matching blocks are looked for.
    """
    wanted = Counter(needle)
    for width in {w for w in (len(needle) - 2, len(needle), len(needle) + 2) if 0 < w <= len(hay)}:
        enough = least * (len(needle) + width) / 2
        missing, common = wanted.copy(), 0
        matcher = SequenceMatcher(None, "", needle, False)
        for i, c in enumerate(hay):
            if c in missing:
                common += missing[c] > 0
                missing[c] -= 1
            if i >= width and (gone := hay[i - width]) in missing:
                missing[gone] += 1
                common -= missing[gone] > 0
            if i + 1 >= width and common >= enough - 1e-9:
                matcher.set_seq1(hay[i + 1 - width : i + 1])
                if matcher.ratio() >= least:
                    return True
    return False


def contains_fuzzy(df: DataFrame, hay: str, needle: str, out: str = "found", least: float = 0.85) -> DataFrame:
    """`df` with whether the needle stands in the hay: letter for letter after folding, or the same digits if it is a
    number, or a window of about its length that is as similar as `least`. Null is in nothing, nor is an empty needle.

    The first two are columns; only rows that they leave open go to Python, and only with these two texts.
    """
    flat = lambda c: F.trim(F.regexp_replace(fold(F.col(c)), "\\s+", " "))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    both = df.drop(out).withColumns({"__h": flat(hay), "__n": flat(needle)})
    h, n = F.col("__h"), F.col("__n")
    number = n.rlike("^[0-9. ]*[0-9][0-9. ]*$")
    told = F.when(h.isNull() | n.isNull() | (n == ""), False).when(h.contains(n), True).when(number, digits(h).contains(digits(n)))

    @F.pandas_udf("boolean")
    def similar(hays: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else alike(x, y, least) for x, y in zip(hays, needles, strict=True)], dtype="object")

    both = both.withColumn("__told", told)
    open_ = F.col("__told").isNull()
    return both.withColumn(out, F.coalesce("__told", similar(F.when(open_, h), F.when(open_, n)))).drop("__h", "__n", "__told")


PUBLIC = "hastane|merkez|laboratuvar|universite"  # entries that name no person, folded without Turkish marks


def leaks(df: DataFrame, by: list[str], masked: str = "masked", pii: str = "pii", keep: str = "keep", text: str = "text", passed: str | None = None) -> DataFrame:
    """By group: cases, personal entries and how many of them still stand in the masked text, medical terms that stood in
    the text and how many of them are gone; with `passed`, the cases that passed the gate, and with a leak in spite of it.

    Entries that name no person don't count, nor do repeated ones or those that are not in the text as written.
    """
    plain = lambda c: ascii_fold(fold(c))
    entries = F.array_distinct(F.filter(F.coalesce(pii, F.array().cast("array<string>")), lambda e: (F.length(F.trim(e)) >= 3) & ~plain(e).rlike(PUBLIC)))
    there = df.withColumns({"__t": plain(F.coalesce(text, F.lit(""))), "__m": plain(F.coalesce(masked, F.lit("")))})
    there = there.withColumn("__e", F.filter(F.transform(entries, plain), lambda e: F.col("__t").contains(e)))
    there = there.withColumn("__k", F.filter(F.transform(F.coalesce(keep, F.array().cast("array<string>")), plain), lambda e: F.col("__t").contains(e)))
    there = there.withColumns({"__leak": F.size(F.filter("__e", lambda e: F.col("__m").contains(e))), "__over": F.size(F.filter("__k", lambda e: ~F.col("__m").contains(e)))})
    more = [F.count_if(F.col(passed)).alias("gate_pass"), F.count_if(F.col(passed) & (F.col("__leak") > 0)).alias("gate_pass_with_leak")] if passed else []
    return there.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("__e")).alias("pii_total"), F.sum("__leak").alias("leaked"), F.sum(F.size("__k")).alias("keep_total"), F.sum("__over").alias("over_deleted"), *more)
