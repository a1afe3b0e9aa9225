"""Problem 4: one consistent form for text that looks the same but differs in its characters.

The skeleton of a text: decompose it, replace every character by its prototype, decompose again; then the
canonical composition is taken, so that the form is ordinary writing. Prototypes: the ordinary characters of a
compatibility form that differs in its shape only (full and half width, mathematical and script letters, small
forms, letters in circles, ligatures, Roman numerals), the ordinary blank of every other blank, nothing for invisible
characters, and the Latin letter for a look-alike letter of another script. Raised and lowered characters and fractions mean
something else than the ordinary ones (10³ is not 103), so they stay, as do line ends and page breaks.

A letter of another script is a look-alike only where it stands in place of a Latin one: in a word that also
has Latin letters, or in a word all of whose letters have a Latin look-alike, unless a neighbouring word of
the same script has letters that no Latin letter looks like (then the passage is written in that script). A
small Greek letter in a word of its own, as in names of substances, stands for itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters and the Latin letter each looks like (fixed values).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜӀѴԌаеѕіјорсухһԁԛԝѵӏү", "ABESIJKMHOPCTYXYQWIVGaesijopcyxhdqwvly", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹονρυικαγηωϲϳ", "ABEZHIKMNOPTYXJCovpuikaynwcj", strict=True))
ARMENIAN = dict(zip("ՕՍՏԼօսհոցզյ", "OUSLouhngqj", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHYGZbRWSVSLCPKdB", strict=True))
COPTIC = dict(zip("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲭ", "ABHIKMNOPCTYXopcx", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU
#: Letters that are taken for Latin in a word without Latin letters: of Greek only the capitals and one small letter.
ALONE = frozenset(LOOKALIKE) - frozenset("νρυικαγηωϲϳ")
#: The other scripts: a letter for each, and where its characters lie.
SCRIPTS = (("C", 0x400, 0x52F), ("G", 0x370, 0x3FF), ("A", 0x530, 0x58F), ("K", 0x13A0, 0x13FF), ("P", 0x2C80, 0x2CFF), ("S", 0xA4D0, 0xA4FF))

SHAPES = ("<font>", "<wide>", "<narrow>", "<small>")


def shape(c: str) -> str:
    """The ordinary characters of a form that differs from them in its shape only; else nothing."""
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if tag not in SHAPES and not (tag == "<circle>" and rest and chr(int(rest.split()[0], 16)).isalpha()) and not 0xFB00 <= ord(c) <= 0xFB06 and not 0x2160 <= ord(c) <= 0x217F:
        return ""
    return unicodedata.normalize("NFKC", c)


BLANKS = "\t" + "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")
PROTOTYPE = {c: s for c in map(chr, range(0x80, 0x20000)) if (s := shape(c))} | dict.fromkeys(BLANKS, " ")
FOREIGN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for _, a, b in SCRIPTS) + "]")
WORD = re.compile(r"[^\W_]+")
#: What a text must have, for anything in it to change: a character outside ASCII and Turkish letters.
ODD = re.compile(r"[^\x00-\x08\x0A-\x7FçğıöşüÇĞİÖŞÜâîûÂÎÛ]")
MORE = re.compile(r"[\t\x80-\U0010FFFF]")
SUSPECT = "[^\\x{00}-\\x{08}\\x{0A}-\\x{7F}çğıöşüÇĞİÖŞÜâîûÂÎÛ]"


def invisible(c: str) -> bool:
    """Format characters and other code points that show nothing."""
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠㅤﾠ" or 0xFE00 <= ord(c) <= 0xFE0F


def script(c: str) -> str:
    """The letter of another script for its letters, L for other letters; empty for what is no letter."""
    if not c.isalpha():
        return ""
    return next((x for x, a, b in SCRIPTS if a <= ord(c) <= b), "L")


def own_script(word: str) -> str:
    """The script in which a word without Latin letters is plainly written, or nothing."""
    kinds = {script(c) for c in word} - {""}
    if len(kinds) != 1 or "L" in kinds:
        return ""
    return kinds.pop() if any(c.isalpha() and c not in LOOKALIKE for c in word) else ""


@lru_cache(10_000)
def latin(c: str) -> str:
    """The Latin letter that a letter looks like, with its marks; else the letter itself."""
    if c in LOOKALIKE or c.isascii():
        return LOOKALIKE.get(c, c)
    parts = unicodedata.normalize("NFD", c)
    new = unicodedata.normalize("NFC", LOOKALIKE.get(parts[0], parts[0]) + parts[1:])
    return new if len(new) == 1 else c


def latin_words(text: str) -> str:
    """The text with look-alike letters replaced where they stand for Latin ones."""
    if not FOREIGN.search(text):
        return text
    words = list(WORD.finditer(text))
    own = [own_script(w.group()) if FOREIGN.search(w.group()) else "" for w in words]
    out, at = [], 0
    for i, m in enumerate(words):
        w = m.group()
        if not FOREIGN.search(w):
            continue
        kinds = {script(c) for c in w} - {""}
        if "L" in kinds:
            new = "".join(map(latin, w))
        elif all(not c.isalpha() or c in ALONE for c in w):
            near = {own[j] for j in (i - 1, i + 1) if 0 <= j < len(words) and "\n" not in text[min(m.end(), words[j].end()) : max(m.start(), words[j].start())]}
            new = w if kinds & near else "".join(LOOKALIKE.get(c, c) for c in w)
        else:
            new = w
        out += [text[at : m.start()], new]
        at = m.end()
    return "".join(out) + text[at:]


@lru_cache(100_000)
def prototype(c: str) -> str:
    """What a single character of a decomposed text becomes, by itself."""
    return "" if ord(c) >= 128 and invisible(c) else PROTOTYPE.get(c, c)


def skeleton(text: str) -> str:
    """The consistent form of a text."""
    if not ODD.search(text):
        return text
    # a small i carries its dot already
    text = unicodedata.normalize("NFD", text).replace("i\u0307", "i").replace("ı\u0307", "i")
    plain = MORE.sub(lambda m: prototype(m.group()), text)
    return unicodedata.normalize("NFC", latin_words(unicodedata.normalize("NFC", plain)))


def formed(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """`df` with the consistent form of `text` in `form`; null stays null, empty stays empty.

    Only texts with a character outside plain Turkish writing go through the Python step. A column of the
    name `form` in `df` is replaced.
    """
    kept = [c for c in df.columns if c != form]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(form, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([None if x is None else skeleton(x) for x in b.columns[-1].to_pylist()], pa.string())], names=[*kept, form])

    suspect = F.when(F.col(text).rlike(SUSPECT), F.col(text))
    done = df.select(*kept, suspect.alias("__suspect")).mapInArrow(run, T.StructType([*schema.fields[:-1], schema.fields[-1]]))
    return done.withColumn(form, F.coalesce(form, text))


def changed(text: str | Column, form: str | Column = "form") -> Column:
    """Whether a text has at least one character that only looks like ordinary writing."""
    return F.coalesce(F.col(text) != F.col(form), F.lit(False)) if isinstance(text, str) else F.coalesce(text != form, F.lit(False))


def entries(ocr: DataFrame, cases: DataFrame) -> DataFrame:
    """(tbl, rec_key, pos, text): each text and each entry of the lists of personal data."""
    a = ocr.select(F.lit("ocr_result").alias("tbl"), F.col("ocr_id").cast("string").alias("rec_key"), F.lit(-1).cast("long").alias("pos"), "text")
    b = cases.select(F.lit("synth_case").alias("tbl"), F.col("id").alias("rec_key"), F.posexplode("pii").alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    return a.unionByName(b)


def groups(df: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """Originals by equal skeleton: the form, how many rows and how many different originals have it.

    Rows are counted by original first, so a form with very many rows is pre-aggregated before the exchange.
    """
    by = df.filter(F.col(form).isNotNull()).groupBy(form, text).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(form).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_originals"))
