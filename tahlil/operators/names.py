"""Names and places found by dictionaries: word pairs, sections left alone, and places read with errors.

Dictionaries are small reference tables of a checked size. Equal words are joined on their folded form; places
misread by a letter or two are compared only within blocks of the same first letter and about the same length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tahlil.functions.let import let
from tahlil.functions.patterns import CAPITALS, LETTERS, anyof
from tahlil.functions.turkish import ascii_fold, upper
from tahlil.operators.rules import CASES as CASES_RULE
from tahlil.operators.rules import NAME, PLACES, place_form
from tahlil.session import made

SENT_ROWS = 200_000
# Endings of surnames (fixed values).
SUFFIXES = ("OĞLU", "OGLU", "GİL", "GIL", "KAYA", "DERE", "TAŞ", "ÖZ", "ALAN", "KIRAN", "BAŞ")
# Names that are also ordinary words; a surname's ending alone is then no proof (fixed values).
AMBIGUOUS = ("DENİZ", "DENIZ", "UMUT", "GÜNEŞ", "GUNES", "TOPRAK", "BAHAR", "YONCA", "ÇINAR", "CINAR", "KARANFİL", "BARIŞ", "BARIS", "YILDIZ", "KAYA", "TAŞ", "SELİM", "ORAL", "CAN", "GÜL", "ATEŞ")
# Beginnings of sections that are medical text, and of the lines that end them (fixed values).
SECTIONS = ("makroskopi", "mikroskopi", "tanı", "epikriz", "immünohistokimya", "histokimya", "klinik bilgi", "klinik öykü", "bulgular", "öykü", "yorum", "sonuç", "ön tanı")
ENDS = ("uzm", "prof", "doç", "op", "yrd", "dr", "asistan", "patolog", "patoloji uzman", "dip", "raporlayan", "onaylayan", "gönderen", "imza", "kurum", "tel", "adres", "e-posta", "hasta ad", "adı soyad", "isteyen doktor", "tc kim")
# Words in capitals that are near a province with an ending, but medical (fixed values).
MEDICAL = frozenset(
    """KARSİNOM KARSİNOMU ADENOKARSİNOM SARKOM LENFOMA MELANOM GLİOBLASTOM SEMİNOM METASTAZ METASTATİK MATERYAL MATERYALİ BİYOPSİ BİYOPSİSİ
    REZEKSİYON EKSİZYON HİSTOLOJİ MİKROSKOPİ MAKROSKOPİ PATOLOJİ ONKOLOJİ HEMATOLOJİ RADYOLOJİ ANAMNEZ TETKİK TETKİKLER TANILAR PROTOKOL""".split()
)
STARTS = f"^[ \\t]*{anyof(*SECTIONS)}(?:$|[^{LETTERS}])"
STOPS = f"^[ \\t]*{anyof(*ENDS)}"
POLITE = ("BEY", "HANIM")  # words behind a name (fixed values)
CASES = ("", "DA", "DE", "DAN", "DEN", "TA", "TE", "YA", "YE")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of each text, lines counted from 0; a null text has none."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def in_sections(text: Column) -> Column:
    """For each line of a text whether it belongs to a medical section: from a line that begins one to before the next
    line that ends it, or the end of the text. Each line gets a sign, and a sign is carried on over the lines without one by one
    replacement, so the cost grows as the text."""
    sign = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(STOPS), "0").when(x.rlike(STARTS), "1").otherwise("."))
    carried = F.regexp_replace(F.array_join(sign, ""), "(?:(?<=1)|(?!^)\\G)\\.", "1")
    return F.transform(F.regexp_extract_all(carried, F.lit("([01.])"), F.lit(1)), lambda x: x == "1")


def pairs(df: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, line_no, pos, w1, w2): each word of a line with the next one. The pairs are made within the row, so nothing
    is exchanged."""
    words = F.regexp_extract_all(line, F.lit(f"([{LETTERS}]+)"), F.lit(1))
    two = let(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("w1"), F.get(w, i + 1).alias("w2"))))
    return df.select(key, "line_no", F.posexplode(two).alias("pos", "p")).select(key, "line_no", "pos", "p.w1", "p.w2")


def dictionary(names: DataFrame) -> DataFrame:
    """(word, is_first, is_surname), a row for each word, also without Turkish marks; marked to be sent if it has at most SENT_ROWS."""
    up = names.filter("token is not null").select(upper(F.col("token")).alias("word"), "is_first", "is_surname")
    both = up.unionByName(up.withColumn("word", ascii_fold(F.col("word"))))
    d = both.groupBy("word").agg(F.bool_or("is_first").alias("is_first"), F.bool_or("is_surname").alias("is_surname"))
    return F.broadcast(d) if d.limit(SENT_ROWS + 1).count() <= SENT_ROWS else d


def name_pairs(docs: DataFrame, names: DataFrame, key: str, text: str, everywhere: bool = False) -> DataFrame:
    """(key, line_no, pos, w1, w2): neighbouring words that are a person's name, outside medical sections (or `everywhere`).

    Both words are known, or a first name stands before a surname or one with a surname's ending (not if either is an
    ordinary word too), or a surname before a first name, or a known word before "Bey" or "Hanım", or an initial
    before a surname. "Umut verici": a small second word is no name.
    """
    line = docs.select(key, F.posexplode(F.arrays_zip(F.split(text, "\n", -1).alias("line"), in_sections(F.col(text)).alias("medical"))).alias("line_no", "x"))
    line = line.select(key, "line_no", "x.line", "x.medical")
    line = line if everywhere else line.filter("not medical")
    two = pairs(line, key).filter("length(w1) <= 20 and length(w2) between 2 and 20")
    two = two.filter(~(F.col("w1").rlike(f"^[{CAPITALS}]") & ~F.col("w2").rlike(f"^[{CAPITALS}]")))
    two = two.withColumns({"u1": upper(F.col("w1")), "u2": upper(F.col("w2"))})
    d = dictionary(names)
    one = d.select(F.col("word").alias("u1"), F.col("is_first").alias("f1"), F.col("is_surname").alias("s1"))
    other = d.select(F.col("word").alias("u2"), F.col("is_first").alias("f2"), F.col("is_surname").alias("s2"))
    j = two.join(one, "u1", "left").join(other, "u2", "left").fillna(False, ["f1", "s1", "f2", "s2"])
    ending = F.lit(False)
    for s in SUFFIXES:
        ending = ending | F.col("u2").endswith(s)
    polite = (F.col("f1") | F.col("s1")) & F.col("u2").isin(*POLITE)
    plain = ~F.col("u1").isin(*AMBIGUOUS) & ~F.col("u2").isin(*AMBIGUOUS)
    initial = (F.length("w1") == 1) & F.col("w1").rlike(f"^[{CAPITALS}]$") & F.col("s2")
    known = (F.col("f1") | F.col("s1")) & (F.col("f2") | F.col("s2"))
    return j.filter(known | polite | initial | (F.col("f1") & ending & plain)).select(key, "line_no", "pos", "w1", "w2")


LABELLED = f"(?:(?:{anyof('hasta adı', 'adı soyadı', 'ad soyad', 'isim', 'hasta', 'refakatçi', 'patolog')}[ \\t]*[:=]{{1,2}}|{anyof('patolog', 'dr.', 'uzm.')})[ \\t]+)({NAME})"


def learned(docs: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(token, is_first, is_surname): words that stand in labelled fields at least so many times, and more often there than
    one time in ten; the forms of a corpus teach its names."""
    named = docs.select(F.explode(F.regexp_extract_all(text, F.lit(LABELLED), F.lit(1))).alias("value"))
    named = named.select(F.explode(F.regexp_extract_all("value", F.lit(f"([{LETTERS}]{{3,}})"), F.lit(1))).alias("word"))
    named = named.groupBy(upper(F.col("word")).alias("token")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
    every = docs.select(F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{3,}})"), F.lit(1))).alias("word")).groupBy(upper(F.col("word")).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return named.join(every, "token").filter(F.col("k") * 10 >= F.col("n")).select("token", F.lit(True).alias("is_first"), F.lit(True).alias("is_surname"))


def labelled_values(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, value): lines "label: First Xxx", whatever the label reads, whose value begins with a first name of
    the dictionary."""
    value = F.regexp_extract("line", f"^[^:\\n]{{1,30}}:[ \\t]*([{CAPITALS}][{LETTERS}]{{1,19}})[ \\t]+([{CAPITALS}][{LETTERS}]{{1,19}})[ \\t]*$", 1)
    rest = F.regexp_extract("line", f"^[^:\\n]{{1,30}}:[ \\t]*([{CAPITALS}][{LETTERS}]{{1,19}})[ \\t]+([{CAPITALS}][{LETTERS}]{{1,19}})[ \\t]*$", 2)
    some = lines(docs, key, text).select(key, "line_no", value.alias("w1"), rest.alias("w2")).filter("w1 <> ''").withColumn("word", upper(F.col("w1")))
    first = dictionary(names).filter("is_first").select("word")
    return some.join(first, "word", "left_semi").select(key, "line_no", F.concat_ws(" ", "w1", "w2").alias("value"))


def exact_places(text: Column) -> Column:
    """The provinces named in a text, each once, as written without their endings; sorted."""
    pattern = f"(?<![{LETTERS}])({'|'.join(place_form(p) for p in sorted(PLACES, key=lambda p: (-len(p), p)))}){CASES_RULE}(?![{LETTERS}])"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def mask_names(docs: DataFrame, names: DataFrame, key: str, text: str, out: str = "masked", everywhere: bool = False) -> DataFrame:
    """(key, out): each text with the names of `name_spans`, and capitals left after a mask tag, replaced. This is the part that SQL
    can say (`a11_names`); the whole layer is `mask_all_names`. A null text stays null."""
    some = docs.select(key, F.col(text).alias(out), F.array().cast("array<string>").alias("__removed"))
    return mask_all_names(some, names, key, out, "__removed", everywhere, whole=False).select(key, out)


def place_forms(spark) -> DataFrame:
    """(place, form): the provinces of six letters or more in capitals, with and without Turkish marks and endings."""
    names = spark.createDataFrame([(p,) for p in PLACES], "place string")
    up = names.select("place", upper(F.col("place")).alias("form")).filter(F.length("form") >= 6)
    up = up.unionByName(up.withColumn("form", ascii_fold(F.col("form")))).distinct()
    return up.select("place", "form", F.explode(F.array(*map(F.lit, CASES))).alias("ending"))


def misread_places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, place): words in capitals that are a province with a letter wrong (two in eight letters or more,
    then also with an ending), but not one letter for letter.

    Blocked by the first letter; lengths within one. The places are 81, so their forms are sent.
    """
    caps = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]+)"), F.lit(1)))).alias("token")).filter(F.col("token").rlike(f"^[{CAPITALS}]{{6,14}}$"))
    forms = F.broadcast(place_forms(docs.sparkSession).withColumns({"block": F.substring("form", 1, 1), "whole": F.concat("form", "ending")}))
    exact = forms.select(F.col("form").alias("token")).distinct()
    some = caps.join(F.broadcast(exact), "token", "left_anti").withColumn("block", F.substring("token", 1, 1))
    near = (F.col("ending") == "") & (F.levenshtein("token", "form", 1).between(0, 1)) | (F.length("token") >= 8) & (F.levenshtein("token", "whole", 2).between(0, 2))
    same = F.abs(F.length("token") - F.length("whole")) <= 1
    return some.join(forms, "block").filter(same & near).select(key, "token", "place").distinct()


MARKLESS = str.maketrans("ÇĞİÖŞÜ", "CGIOSU")


def upper_text(x: str) -> str:
    """Upper case in Turkish, as `upper` does it."""
    return x.replace("i", "İ").replace("ı", "I").upper()


@cache
def _place_words() -> dict[str, list[tuple[str, tuple[str, ...]]]]:
    """By first letter: the provinces in capitals as in `place_forms`, each with its forms with endings."""
    out: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
    for form in sorted({f for p in map(upper_text, PLACES) if len(p) >= 6 for f in (p, p.translate(MARKLESS))}):
        out.setdefault(form[0], []).append((form, tuple(form + e for e in CASES)))
    return out


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@lru_cache(100_000)
def misread(token: str) -> bool:
    """Whether a word in capitals is a province read with errors: within the bounds of `misread_places`, compared with and
    without Turkish marks; words that are medical are none with two letters wrong."""
    forms, plain = _place_words().get(token[0], []), token.translate(MARKLESS)
    if not 6 <= len(token) <= 14 or any(token == f or plain == f for f, _ in forms):
        return False
    for form, whole in forms:
        if abs(len(form) - len(token)) <= 1 and min(distance(token, form), distance(plain, form)) <= 1:
            return True
        if len(token) >= 8 and token not in MEDICAL and any(abs(len(w) - len(token)) <= 1 and min(distance(token, w), distance(plain, w)) <= 2 for w in whole):
            return True
    return False


# Letters as the rules know them: Python's word characters without digits, "_" and other numbers such as "²".
LETTER = "[^\\W\\d_" + re.escape("".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())) + "]"
TOKEN = re.compile(f"{LETTER}+")
PLACE_CASE = re.compile("['’](?:DAN|DEN|TAN|TEN|DA|DE|TA|TE|NIN|NİN|YA|YE|LI|Lİ)" + f"(?!{LETTER})")


def without_misread_places(text: str) -> str:
    """A text with its misread provinces, and their endings behind an apostrophe, replaced."""
    out, done = [], 0
    for m in TOKEN.finditer(text):
        if 6 <= len(m.group()) <= 14 and m.group().isupper() and misread(m.group()):
            case = PLACE_CASE.match(text, m.end())
            out += [text[done : m.start()], "[SEHIR_SILINDI]"]
            done = case.end() if case else m.end()
    return "".join(out) + text[done:]


def mask_misread_places(df: DataFrame, text: str, removed: str) -> DataFrame:
    """`df` with misread provinces replaced in `text`, and reported in the array `removed`."""
    schema, order = df.schema, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, said = b.column(order.index(text)), b.column(order.index(removed))
            new = [None if t is None else without_misread_places(t) for t in old.to_pylist()]
            more = [[*(r or []), "Şehir (bozuk okunmuş)"] if t != n else r for t, n, r in zip(old.to_pylist(), new, said.to_pylist(), strict=True)]
            columns = dict(zip(order, b.columns, strict=True)) | {text: pa.array(new, old.type), removed: pa.array(more, said.type)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)

    return df.mapInArrow(run, schema)


# Labels whose values are no names (fixed values), and what the sub-rules of the dictionary look for.
NO_NAME_LABELS = re.compile("TANI|MAKRO|M[İI]KRO|KL[İI]N[İI]K|Ş[İI]KAYET|BULGU|MATERYAL|TETK[İI]K|SERV[İI]S|B[ÖO]L[ÜU]M|ÖYK[ÜU]|OYKU|[İI]STEM|TEDAV[İI]|[İI]LA[ÇC]|SONU[ÇC]|YER[İI]|T[İI]P[İI]|NUMUNE|DOKU|ADET|TÜR[ÜU]|TURU")
SHORT = f"{LETTER}{{2,20}}"
LABEL_VALUE = re.compile(f"([^:\\n]{{1,30}}):[ \\t]*({SHORT}(?:[ \\t]+{SHORT}){{1,2}})[ \\t]*")
GLUED = re.compile(f"[\"'’`][ \\t\\n]*({LETTER}{{2,15}})[ \\t\\n]+({SHORT})(?!{LETTER})")
SILE = re.compile(f"(?<!{LETTER})sile[ \\t]+AEA[ \\t]*[:.]?(?:[ \\t]*{LETTER}+){{1,4}}", re.IGNORECASE)
TITLED = re.compile(f"(?<!{LETTER})DR[ \\t\\n]+({SHORT})(?!{LETTER})")
CAPITAL = "".join(["[A-Z", *(c for c in map(chr, range(0x80, 0x10000)) if c.isupper() and c.isalpha()), "]"])
LEFT = re.compile(f"(\\[(?:DOKTOR|HASTA_ADI|ISIM|BABA_ADI)_SILINDI\\])(?:[ \\t]+{CAPITAL}{{2,}}(?:[ \\t]*\\.)?)+(?=[ \\t]*(?:\\n|$|[:|]))")
CONTACT = re.compile(f"(\\[(?:WEB|ILETISIM|EMAIL)_SILINDI\\])[ \\t\\n]*({LETTER}{{2,15}})[ \\t\\n]+({SHORT})(?!{LETTER})")
NAME_TAG = "[ISIM_SILINDI]"
LINE_END = re.compile(f"(?<!{LETTER})({SHORT})[ \\t]*\\n[ \\t]*({LETTER}+)(?!{LETTER})")
REPEATED = re.compile("\\[ISIM_SILINDI\\](?:[ \\t]*\\[ISIM_SILINDI\\])+")
NAMES_REMOVED = ("İsim (sözlük)", "İsim (satır sonu)", "İsim (bozuk etiket + sözlük)", "İsim (yapışık)", "İsim (bozuk okunmuş)", "Doktor (DR+sözlük)", "İsim (etiket sonrası kalıntı)", "İsim (etiket sonrası)")


def name_spans(text: str, known: dict[str, tuple[bool, bool]], medical: list[bool] | None) -> list[tuple[int, int]]:
    """(begin, end) of the names by the rules of `name_pairs`, only blanks between their words (a full stop behind an
    initial), and of a known third word, by their place: the same words elsewhere are no concern of it. Spans that touch are one."""
    spans, at = [], 0
    for no, line in enumerate(text.split("\n")):
        words = [] if medical and medical[no] else list(TOKEN.finditer(line))
        for i, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            w1, w2, between = a.group(), b.group(), line[a.end() : b.start()]
            letter = len(w1) == 1 and w1.isupper()
            if not (between.strip(" \t") == "" or letter and between.rstrip(" \t") == ".") or len(w1) > 20 or not 2 <= len(w2) <= 20 or w1[0].isupper() and not w2[0].isupper():
                continue
            (f1, s1), (f2, s2), u1, u2 = known.get(w1, (False, False)), known.get(w2, (False, False)), upper_text(w1), upper_text(w2)
            one = f1 or s1
            ending = f1 and u2.endswith(SUFFIXES) and u1 not in AMBIGUOUS and u2 not in AMBIGUOUS
            if not (one and (f2 or s2) or one and u2 in POLITE or letter and s2 or ending):
                continue
            third = words[i + 2] if i + 2 < len(words) and line[b.end() : words[i + 2].start()].strip(" \t") == "" and any(known.get(words[i + 2].group(), ())) else None
            spans.append((at + a.start(), at + (third or b).end()))
        at += len(line) + 1
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and text[out[-1][1] : b].strip(" \t") == "":
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def polite(text: str, known, calm) -> list[tuple[int, int]]:
    """(begin, end) of the names at the end of a line with "Bey" or "Hanım" at the beginning of the next."""
    return [m.span(1) for m in LINE_END.finditer(text) if calm(m) and any(known.get(m[1], ())) and upper_text(m[2]) in POLITE]


def without_names(text: str, known, medical: list[bool] | None = None, whole: bool = True) -> tuple[str, list[str]]:
    """A text without its names, and the sub-rules that applied, in order; with `whole` off only the first and the one for what is
    left behind a tag.

    `known`: gives of a word of the dictionary (is_first, is_surname). `medical`: for each line whether it
    belongs to a medical section, where only titled names and what stands beside tags is replaced.
    """
    first, surname, name = (lambda w: known.get(w, (False, False))[0]), (lambda w: known.get(w, (False, False))[1]), (lambda w: any(known.get(w, ())))
    calm = lambda m: not (medical and medical[m.string.count("\n", 0, m.start())])
    steps = [text]

    def cut(some: list[tuple[int, int]]) -> None:
        out, done = [], 0
        for b, e in some:
            out += [steps[-1][done:b], NAME_TAG]
            done = e
        steps.append("".join(out) + steps[-1][done:])

    def sub(pattern: re.Pattern, new) -> None:
        steps.append(pattern.sub(new, steps[-1]))

    cut(name_spans(text, known, medical))
    if whole:
        cut(polite(steps[-1], known, calm))
        lines = steps[-1].split("\n")
        for i, line in enumerate(lines):
            m = None if medical and medical[i] else LABEL_VALUE.fullmatch(line)
            if m and not NO_NAME_LABELS.search(upper_text(m[1])):
                words = m[2].split()
                if first(words[0]) and all(w[0].isupper() for w in words) and not any(upper_text(w) in AMBIGUOUS for w in words):
                    lines[i] = line[: m.start(2)] + NAME_TAG + line[m.end(2) :]
        steps.append("\n".join(lines))
        sub(GLUED, lambda m: NAME_TAG if calm(m) and (first(m[1]) or surname(m[2])) else m[0])
        sub(SILE, NAME_TAG)
        sub(TITLED, lambda m: "[DOKTOR_SILINDI]" if name(m[1]) else m[0])
    sub(LEFT, r"\1")
    if whole:
        sub(CONTACT, lambda m: f"{m[1]} {NAME_TAG}" if name(m[2]) or name(m[3]) else m[0])
    told = NAMES_REMOVED if whole else (NAMES_REMOVED[0], NAMES_REMOVED[6])
    return REPEATED.sub(NAME_TAG, steps[-1]), [n for n, a, b in zip(told, steps[:-1], steps[1:], strict=True) if a != b]


class Lookup:
    """A dictionary of names that is asked for words as they are written."""

    def __init__(self, rows: list[tuple[str, bool, bool]]):
        self.words = {w: (f, s) for w, f, s in rows}
        self.asked: dict[str, tuple[bool, bool]] = {}

    def get(self, w: str, other: tuple = ()) -> tuple:
        """(is_first, is_surname) of a word, with or without its Turkish marks; `other` if it is no name."""
        if (k := self.asked.get(w)) is None:
            if len(self.asked) > 200_000:
                self.asked.clear()
            up = upper_text(w)
            a, b = (self.words.get(x, (False, False)) if 2 <= len(w) <= 20 else (False, False) for x in (up, up.translate(MARKLESS)))
            k = self.asked[w] = (a[0] or b[0], a[1] or b[1])
        return k if k != (False, False) else other


def mask_all_names(docs: DataFrame, names: DataFrame, key: str, text: str, removed: str, everywhere: bool = False, whole: bool = True) -> DataFrame:
    """`docs` with the names of the dictionary replaced in `text`, by all sub-rules, and reported in the array `removed`.

    A dictionary of at most SENT_ROWS words goes to the workers, and nothing is exchanged. The words of a larger one, which the
    forms of a corpus may teach, come to the texts by a join and back by the key. A null text stays null.
    """
    schema, order = docs.schema, docs.columns
    d = dictionary(names)
    calm = F.lit(None).cast("array<boolean>") if everywhere else in_sections(F.col(text))
    docs = docs.withColumn("__medical", calm)
    if (small := d.limit(SENT_ROWS + 1).count() <= SENT_ROWS):
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in d.select("word", "is_first", "is_surname").collect()])
        docs = docs.withColumn("__known", F.lit(None).cast("array<struct<w:string,is_first:boolean,is_surname:boolean>>"))
    else:
        words = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]+)"), F.lit(1)))).alias("w")).filter("length(w) between 2 and 20")
        words = words.select(key, "w", F.explode(F.array_distinct(F.array(upper(F.col("w")), ascii_fold(upper(F.col("w")))))).alias("word"))
        found = words.join(d, "word").groupBy(F.col(key).alias("__of")).agg(F.collect_set(F.struct("w", "is_first", "is_surname")).alias("__known"))
        docs, sent = docs.join(found, F.col(key).eqNullSafe(F.col("__of")), "left").drop("__of"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = made(sent, Lookup) if small else None
        for b in batches:
            new, more = [], []
            for t, said, medical, found in zip(*(b.column(c).to_pylist() for c in (text, removed, "__medical", "__known")), strict=True):
                known = every
                if known is None:
                    known = {}
                    for r in found or ():
                        f, s = known.get(r["w"], (False, False))
                        known[r["w"]] = (f or r["is_first"], s or r["is_surname"])
                masked, kinds = (None, []) if t is None else without_names(t, known, medical, whole)
                new.append(masked)
                more.append([*(said or []), *kinds])
            columns = {c: b.column(c) for c in order} | {text: pa.array(new, pa.string()), removed: pa.array(more, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)

    return docs.mapInArrow(run, schema)
