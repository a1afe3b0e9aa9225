"""The most frequent rows of a table of counts, as many as a bound allows, without sorting or collecting the table."""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, FINE = 4_096, 512  # counts below are levels of their own; levels for each doubling above
CELLS = 64  # expected cells of the hash for as many rows as are still wanted


def level(n: Column) -> Column:
    """The level of a count: the count itself when it is small, else its place on a logarithmic scale. There are about
    30,000 levels, whatever the counts."""
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor((F.log2(n) - floor(log2(EXACT))) * FINE)).cast("int")


def chosen(table: DataFrame, by: str, most: int, *key: str) -> Column:
    """A condition that holds for the rows with the greatest counts `by`, at most `most` of them; of the level that is
    cut, the rows whose hash of `key` comes first. It is never true for a null count.

    What comes to the driver are two histograms of bounded length: by level, and of the level that is cut by hash. So
    the result is full at any size and with any ties, and the rest of the table is the negation of the condition.
    """
    n = F.col(by).cast("long")
    rows = table.filter(n.isNotNull()).groupBy(level(n).alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    held, cut = 0, None
    for r in sorted(rows, reverse=True):
        if held + r.rows > most:
            cut = r
            break
        held += r.rows
    if cut is None:
        return n.isNotNull()
    left = most - held
    if left <= 0:
        return F.coalesce(level(n) > cut.level, F.lit(False))
    scale = float(max(1, CELLS * cut.rows // left))
    cell = F.floor(F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(2.0**53) * F.lit(scale))
    found = table.filter((level(n) == cut.level) & (cell < 4 * CELLS)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows")).collect()
    first = -1
    for r in sorted(found):
        if r.rows > left:
            break
        left, first = left - r.rows, r.cell
    return F.coalesce((level(n) > cut.level) | ((level(n) == cut.level) & (cell <= first)), F.lit(False))
