"""Units of measurement: their spellings, their sizes, and finding them beside numbers in text.

All spellings go into one multi-pattern automaton. Of the spellings found beside a number the longest wins;
where one spelling means two units (g/L and G/L, mm and mM), the dimension of the field decides.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick

from tahlil.functions.turkish import lower

# Units: name, dimension, size in the dimension's base unit, spellings (fixed values). Base units: g/L,
# mol/L, U/L, 1/L, m, 1 and kat are written as such; katal is given in U. Spellings are folded and
# without blanks.
UNITS = (
    ("ng/mL", "mass", 1e-6, "ng/ml nanogram/mililitre nanogram/ml"),
    ("µg/L", "mass", 1e-6, "µg/l ug/l mcg/l mikrogram/litre mikrogram/l"),
    ("pg/mL", "mass", 1e-9, "pg/ml pikogram/mililitre pikogram/ml"),
    ("ng/L", "mass", 1e-9, "ng/l ng/lt nanogram/litre"),
    ("ng/dL", "mass", 1e-8, "ng/dl ng/100ml nanogram/desilitre"),
    ("µg/mL", "mass", 1e-3, "µg/ml ug/ml mcg/ml mikrogram/mililitre"),
    ("µg/dL", "mass", 1e-5, "µg/dl ug/dl mcg/dl mikrogram/desilitre"),
    ("g/dL", "mass", 10.0, "g/dl gr/dl g/100ml gram/desilitre %g %gr"),
    ("g/L", "mass", 1.0, "g/l gr/l g/lt gr/lt gram/litre"),
    ("mg/mL", "mass", 1.0, "mg/ml miligram/mililitre"),
    ("mg/dL", "mass", 1e-2, "mg/dl mg/100ml %mg miligram/desilitre"),
    ("mg/L", "mass", 1e-3, "mg/l mg/lt miligram/litre"),
    ("mmol/L", "amount", 1e-3, "mmol/l mmol/lt mm milimol/litre"),
    ("µmol/L", "amount", 1e-6, "µmol/l umol/l mikromol/litre µm um"),
    ("nmol/L", "amount", 1e-9, "nmol/l nanomol/litre nm"),
    ("pmol/L", "amount", 1e-12, "pmol/l pikomol/litre pm"),
    ("U/mL", "activity", 1e3, "u/ml iu/ml ünite/ml ünite/mililitre"),
    ("U/L", "activity", 1.0, "u/l iu/l u/lt iu/lt ünite/litre ünite/l"),
    ("kU/L", "activity", 1e3, "ku/l kiu/l"),
    ("mU/mL", "activity", 1.0, "mu/ml miu/ml"),
    ("mU/L", "activity", 1e-3, "mu/l miu/l"),
    ("µkat/L", "activity", 60.0, "µkat/l ukat/l mikrokatal/l mikrokatal/litre"),
    ("nkat/L", "activity", 0.06, "nkat/l nanokatal/l nanokatal/litre"),
    ("10^9/L", "count", 1e9, "10^9/l x10^9/l x10e9/l 10e9/l g/l"),
    ("10^3/µL", "count", 1e9, "10^3/µl x10^3/µl 10^3/ul x10^3/ul x10e3/µl x10e3/ul k/ul k/µl bin/mm3 bin/mm^3 bin/µl bin/ul"),
    ("/mm3", "count", 1e6, "/mm3 /mm^3 hücre/mm3 hücre/mm^3 adet/mm3"),
    ("/µL", "count", 1e6, "/µl /ul hücre/µl hücre/ul adet/µl"),
    ("/L", "count", 1.0, "/l hücre/litre hücre/l /litre"),
    ("10^6/µL", "count", 1e12, "10^6/µl x10^6/µl 10^6/ul x10^6/ul m/ul"),
    ("m", "length", 1.0, "m metre m."),
    ("cm", "length", 1e-2, "cm cm. santimetre santim"),
    ("mm", "length", 1e-3, "mm mm. milimetre"),
    ("µm", "length", 1e-6, "µm um mikron mikrometre"),
    ("%", "part", 1e-2, "% pct yüzde"),
    ("binde", "part", 1e-3, "‰ binde"),
    ("oran", "part", 1.0, "oran kesir (0-1arası) 0-1arası"),
)
#: Spellings that stand before their number.
BEFORE = frozenset({"%", "yüzde", "‰", "binde"})
SIGNS = str.maketrans({"⁹": "^9", "³": "^3", "⁶": "^6", "μ": "µ", "×": "x", "*": "x"})
# Turkish number words (fixed values).
ONES = dict(zip("sıfır bir iki üç dört beş altı yedi sekiz dokuz".split(), range(10), strict=True))
TENS = dict(zip("on yirmi otuz kırk elli altmış yetmiş seksen doksan".split(), range(10, 100, 10), strict=True))
WORDS = "|".join(sorted([*ONES, *TENS], key=len, reverse=True))
NUMBER = re.compile(
    r"(?P<n>\d{1,3}(?:[. ]\d{3})+(?![\d.,])(?:,\d+)?|\d+(?:[.,]\d+)?)(?:\s*x\s*10\s*\^\s*(?P<e>\d{2,})|\s*x\s*10\s*\^\s*(?P<f>\d)(?!\d|\s*/\s*[lµu])|e(?P<g>\d+))?"
    rf"|(?<![^\W\d_])(?P<w>(?:{WORDS})(?:\s+(?:{WORDS}))*)"
)


def squeezed(text: str) -> tuple[str, list[int]]:
    """The text folded, without blanks; and the place in the text of each character that is left."""
    text = text.translate(SIGNS)
    kept = [(c, i) for i, c in enumerate(text) if not c.isspace()]
    out, at = [], []
    for c, i in kept:
        for x in lower(c).replace("ı", "i"):
            out.append(x)
            at.append(i)
    return "".join(out), at


def plain_text(text: str) -> str:
    """The text folded, with one spelling of signs."""
    return lower(text.translate(SIGNS))


LONGEST = max(len(s) for u in UNITS for s in u[3].split())


def beside(text: str, at: int, step: int) -> tuple[str, list[int]]:
    """As many characters without blanks as the longest spelling may need, with one more, from a place on (step 1) or before it (step
    -1), squeezed; however many blanks stand between."""
    begin = end = at
    left = LONGEST + 8
    while left and 0 <= (i := end if step > 0 else begin - 1) < len(text):
        begin, end = (begin, end + 1) if step > 0 else (begin - 1, end)
        left -= not text[i].isspace()
    return squeezed(text[begin:end])


@cache
def automaton() -> ahocorasick.Automaton:
    """All spellings; each with the units it may mean."""
    means: dict[str, list[int]] = {}
    for k, (_, _, _, spellings) in enumerate(UNITS):
        for s in spellings.split():
            means.setdefault(s.replace("ı", "i"), []).append(k)
    a = ahocorasick.Automaton()
    for s, units in means.items():
        a.add_word(s, (s, units))
    a.make_automaton()
    return a


def unit_beside(text: str, begin: int, end: int, dimensions: tuple[str, ...]) -> tuple[int, int]:
    """The unit written directly behind text[begin:end], or before it, in one of the dimensions, and the place
    where it ends; (-1, end) if there is none.

    `text` is folded. Blanks between do not count; the spelling must not go on in a longer word.
    """
    tail, at = beside(text, end, 1)
    best = (0, -1, end)
    for last, (spelling, units) in automaton().iter(tail):
        whole = not (spelling[-1].isalpha() and tail[last + 1 : last + 2].isalpha() and at[last + 1] == at[last] + 1)
        if last - len(spelling) == -1 and whole:
            for u in units:
                if UNITS[u][1] in dimensions and len(spelling) > best[0]:
                    best = (len(spelling), u, end + at[last] + 1)
    if best[1] >= 0:
        return best[1:]
    head, _ = beside(text, begin, -1)
    head = head.rstrip("<>~≤≥=")
    for last, (spelling, units) in automaton().iter(head):
        if spelling in BEFORE and last == len(head) - 1:
            for u in units:
                if UNITS[u][1] in dimensions and len(spelling) > best[0]:
                    best = (len(spelling), u, end)
    return best[1:]


def unit_in_brackets(name: str, dimensions: tuple[str, ...]) -> int:
    """The unit in brackets within a field's name, in one of the dimensions; else -1."""
    for inside in re.findall(r"[(\[]([^)\]]*)[)\]]", name):
        s, _ = squeezed(inside)
        for form in (s, f"({s})"):  # a scale is spelled with its brackets
            for u in automaton().get(form, ("", []))[1]:
                if UNITS[u][1] in dimensions:
                    return u
    return -1


def unit_named(name: str, dimensions: tuple[str, ...]) -> int:
    """The unit of a spelling on its own; else -1."""
    s, _ = squeezed(name)
    return next((u for u in automaton().get(s, ("", []))[1] if UNITS[u][1] in dimensions), -1)


def number(m: re.Match) -> float:
    """The value of a match of NUMBER. A dot or blank before a last group of three digits only groups digits
    in a number of 10,000 or more; else a dot is a decimal point."""
    if m["w"]:
        return float(sum({**ONES, **TENS}[w] for w in m["w"].split()))
    raw = m["n"]
    if re.fullmatch(r"\d{1,3}(?:[. ]\d{3})+(?:,\d+)?", raw):
        whole = re.sub(r"[. ]", "", raw.split(",")[0])
        if int(whole) >= 10_000:
            value = float(whole + ("." + raw.split(",")[1] if "," in raw else ""))
        else:
            value = float(raw.replace(" ", "").replace(",", "."))
    else:
        value = float(raw.replace(",", "."))
    exponent = m["e"] or m["f"] or m["g"]
    return value * 10 ** int(exponent) if exponent else value


def numbers(text: str, dimensions: tuple[str, ...]) -> list[tuple[int, int, float, int]]:
    """(begin, end, value, unit or -1) of the numbers in a folded text. Digits of a unit are no number, nor are
    the bounds of a scale in brackets."""
    out, at = [], 0
    while m := NUMBER.search(text, at):
        at = m.end()
        before = text[m.start() - 1 : m.start()] if m.start() else ""
        if before.isalpha() and before != "x" and not m["w"]:
            continue
        unit, at = unit_beside(text, m.start(), m.end(), dimensions)
        out.append((m.start(), m.end(), number(m), unit))
    return out


def factor(unit: int, common: int, molar_mass: float | None) -> float | None:
    """By what a value in one unit is multiplied to be in the other; None where they do not agree."""
    (_, da, sa, _), (_, db, sb, _) = UNITS[unit], UNITS[common]
    if da == db:
        return sa / sb
    if {da, db} == {"mass", "amount"} and molar_mass:
        return sa * molar_mass / sb if da == "amount" else sa / molar_mass / sb
    return None
