"""Problem 1: quantities recorded in different units, brought to one common unit each.

The reading's field is found in the reference list (symmetric-delete lookup), its numbers and units by the
automaton of unit spellings, with the field's dimension as context. The rest is joins: the unit a laboratory
means when it writes none, and the conversion factor by quantity and unit, both small tables of a checked
size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tahlil.functions import units as U
from tahlil.functions.terms import Terms
from tahlil.session import made

#: Most rows of a table that is sent to all executors; into how many parts a laboratory's readings are split beyond that.
SENT_ROWS, PARTS = 200_000, 16
#: Most rows of the reference lists of terms and of quantities.
LIST_MOST = 20_000
READ = "marker_id long, lab_code string, quantity_id long, unit int, pos int, written double"


def listed(df: DataFrame, *columns: str) -> list:
    """The rows of a reference list, which is refused beyond LIST_MOST rows before anything of it is read."""
    if (n := df.count()) > LIST_MOST:
        raise ValueError(f"the reference list has {n} rows; at most {LIST_MOST} are sent to the executors")
    return df.select(*columns).collect()


def with_source(got: DataFrame, own: DataFrame) -> DataFrame:
    """`got` with the `source_unit` of its laboratory and quantity. A table beyond SENT_ROWS is joined by an exchange, in which the
    readings of a laboratory are split into PARTS, as one may hold a third of all."""
    keys = ["lab_code", "quantity_id"]
    if own.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        return got.join(F.broadcast(own), keys, "left")
    parts = own.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    some = got.withColumn("__part", F.pmod(F.xxhash64("marker_id", "pos"), F.lit(PARTS)).cast("int"))
    return some.join(parts.hint("merge"), [*keys, "__part"], "left").drop("__part")


def usable(quantities: DataFrame) -> list:
    """The rows of the list of quantities that have an id, a name and a common unit that is known."""
    known = [u[0] for u in U.UNITS]
    return [r for r in listed(quantities, "quantity_id", "quantity", "common_unit", "molar_mass") if r.quantity_id is not None and r.quantity and r.common_unit in known]


def dimensions(common: str, molar_mass: float | None) -> tuple[str, ...]:
    """The dimensions in which a quantity of this common unit may be written."""
    own = {"activity": ("activity",), "count": ("count",), "length": ("length",), "part": ("part",)}
    k = next(i for i, u in enumerate(U.UNITS) if u[0] == common)
    return own.get(U.UNITS[k][1]) or (("mass", "amount") if molar_mass else ("mass",))


def read(markers: DataFrame, terms: DataFrame, quantities: list) -> DataFrame:
    """The numbers of every reading of a listed quantity: `pos` counts them from 0, `written` is the number as
    written, `unit` the place of its unit in UNITS, or -1 where the reading names none.

    The unit is the one in `deger`, else in `ad`, else beside the same number in `kanit`. Readings with null
    `ad` or `deger` and those of no listed quantity give no row, nor do those without a number.
    """
    entries = [(r.term_id, r.term, list(r.aliases or []), 1) for r in listed(terms.filter("field = 'ad'"), "term_id", "term", "aliases")]
    by_term = {r.quantity: (r.quantity_id, dimensions(r.common_unit, r.molar_mass)) for r in quantities}
    names = {i: t for i, t, _, _ in entries}
    sent = markers.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = made(sent, Terms)
        for b in batches:
            rows = []
            for marker, lab, ad, deger, kanit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                quantity = by_term.get(names.get(index.match(ad)[0], ""))
                if quantity:
                    unit, values = reading(ad, deger, kanit, quantity[1])
                    rows += [(marker, lab, quantity[0], unit, k, v) for k, v in enumerate(values)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["marker_id", "lab_code", "quantity_id", "unit", "pos", "written"])

    some = markers.filter("ad is not null and deger is not null").select("marker_id", "lab_code", "ad", "deger", "kanit")
    return some.mapInArrow(run, READ)


def reading(ad: str, deger: str, kanit: str | None, allowed: tuple[str, ...]) -> tuple[int, list[float]]:
    """The unit of one reading (-1 if it names none) and its numbers."""
    text = U.plain_text(deger)
    found = U.numbers(text, allowed)
    if not found:
        return -1, []
    unit = next((n[3] for n in found if n[3] >= 0), -1)
    if unit < 0:
        unit = U.unit_in_brackets(ad, allowed)
    if unit < 0 and kanit:
        proof, raw = U.plain_text(kanit), text[found[0][0] : found[-1][1]]
        begin = proof.find(raw)
        while begin >= 0 and unit < 0:
            unit, _ = U.unit_beside(proof, begin, begin + len(raw), allowed)
            begin = proof.find(raw, begin + 1)
    return unit, [n[2] for n in found]


def conversion(spark: SparkSession, quantities: list) -> DataFrame:
    """(quantity_id, unit, unit_name, common_unit, factor) for every unit a quantity may be written in: at most LIST_MOST times the
    number of units, a few MB."""
    rows = []
    for q in quantities:
        common = next(i for i, u in enumerate(U.UNITS) if u[0] == q.common_unit)
        for k, u in enumerate(U.UNITS):
            f = U.factor(k, common, q.molar_mass)
            if f is not None:
                rows.append((q.quantity_id, k, u[0], q.common_unit, float(f)))
    return spark.createDataFrame(rows, "quantity_id long, unit int, unit_name string, common_unit string, factor double")


def converted(markers: DataFrame, terms: DataFrame, quantities: DataFrame, sources: DataFrame) -> DataFrame:
    """Every number of every reading of a listed quantity in the common unit: marker_id, pos, quantity_id,
    `written`, `unit_name`, `value`, `common_unit`.

    Where neither the reading nor its laboratory names a unit (or there is no laboratory), unit and value are
    null. `terms`, `quantities` and `sources` are small reference tables, of which rows with nulls or
    unknown units don't count; repeated rows of the first two
    change nothing, and of two units of one laboratory for one quantity the first by name counts.
    """
    spark = markers.sparkSession
    own = sources.groupBy("lab_code", "quantity_id").agg(F.min("unit").alias("unit_text"))
    names = [(u[0], k) for k, u in enumerate(U.UNITS)]
    named = spark.createDataFrame(names, "unit_text string, source_unit int")
    own = own.join(F.broadcast(named), "unit_text").select("lab_code", "quantity_id", "source_unit")
    some = usable(quantities)
    got = with_source(read(markers, terms, some), own)
    got = got.withColumn("unit", F.when(F.col("unit") >= 0, F.col("unit")).otherwise(F.col("source_unit")))
    out = got.join(F.broadcast(conversion(spark, some)), ["quantity_id", "unit"], "left")
    return out.select("marker_id", "pos", "quantity_id", "written", "unit_name", (F.col("written") * F.col("factor")).alias("value"), "common_unit")


def differing(values: DataFrame) -> DataFrame:
    """(marker_id, quantity_id) of readings with a number that is not the number in the common unit."""
    off = F.abs(F.col("value") - F.col("written")) > 1e-9 * F.abs(F.col("written"))
    return values.filter(off).select("marker_id", "quantity_id").distinct()
