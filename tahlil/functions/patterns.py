"""Rules as data: a pattern, what must not stand beside it, and what takes its place.

Patterns use only what Java's and RE2's dialects share, without flags: letters are spelled as classes of all
their cases (Turkish i, ı, İ, I count as one letter), so both read them alike. What must not stand beside a
match is kept apart from the pattern: Spark checks it by looking around, other engines may consume it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tahlil.functions.let import let

LETTERS = "\\p{L}"
CAPITALS = "\\p{Lu}"
#: What may not stand beside a match, by name.
BESIDE = {"": "", "word": f"{LETTERS}0-9_", "digit": "0-9", "letter": LETTERS}
SAME = {c: f"[{group}]" for group in ("iıİI", "sSşŞ", "gGğĞ", "cCçÇ", "oOöÖ", "uUüÜ") for c in group}


def anycase(text: str) -> str:
    """A text as a pattern that takes every case of its letters; a blank takes one or more, ~ none or more, and a
    full stop one or none."""
    out = []
    for c in text:
        if c == " ":
            out.append("[ \\t]+")
        elif c == "~":
            out.append("[ \\t]*")
        elif c == ".":
            out.append("\\.?")
        elif c in SAME:
            out.append(SAME[c])
        elif c.isalpha():
            out.append(f"[{c.lower()}{c.upper()}]")
        else:
            out.append(c if c.isalnum() else "\\" + c)
    return "".join(out)


def anyof(*texts: str) -> str:
    """One of the texts in every case, the longest first."""
    return "(?:" + "|".join(anycase(t) for t in sorted(texts, key=len, reverse=True)) + ")"


#: A class of characters or an ordinary one that stands once; and an alternative outside of all brackets.
FIRST = re.compile(r"(?:\[[^\]^][^\]]*\]|[0-9A-Za-z])(?![?*+{])")
TOP_CHOICE = re.compile(r"^[^()]*(?:\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)[^()]*)*\|")


@dataclass(frozen=True)
class Rule:
    """What `body` matches becomes `tag`; `name` is what is reported."""

    layer: str
    name: str
    body: str
    tag: str
    left: str = ""
    right: str = ""
    needs: str = ""  # a pattern that is cheap to look for and without which nothing can match

    def java(self) -> str:
        """The pattern for Spark. Where the body begins with one character, that is asked first and the look back starts behind it, so
        that most places of a text fail at once."""
        a, b = BESIDE[self.left], BESIDE[self.right]
        behind = f"(?![{b}])" if b else ""
        if a and (m := FIRST.match(self.body)) and not TOP_CHOICE.search(re.sub(r"\\.|\[[^\]]*\]", "", self.body)):
            return f"{m.group()}(?<![{a}].)(?:{self.body[m.end() :]}){behind}"
        return (f"(?<![{a}])" if a else "") + f"(?:{self.body}){behind}"

    def sql(self, text: str) -> str:
        """A DuckDB expression that applies the rule to the expression `text`."""
        a, b = BESIDE[self.left], BESIDE[self.right]
        pattern = (f"(^|[^{a}])" if a else "()") + f"(?:{self.body})" + (f"($|[^{b}])" if b else "()")
        once = lambda x: f"regexp_replace({x}, '{quoted(pattern)}', '\\1{quoted(self.tag)}\\2', 'g')"
        return once(once(text)) if b else once(text)  # a consumed neighbour may be the next match's


def quoted(x: str) -> str:
    """The inside of a SQL string."""
    return x.replace("'", "''")


def java_quoted(tag: str) -> str:
    """A replacement text with nothing that the regular expression engine reads as a group."""
    return tag.replace("\\", "\\\\").replace("$", "\\$")


def apply(c: Column, rules: list[Rule]) -> Column:
    """The text after all rules, in order. A rule that needs something is only tried on texts that have it."""
    for r in rules:
        put = lambda x, r=r: F.regexp_replace(x, F.lit(r.java()), F.lit(java_quoted(r.tag)))
        c = let(c, lambda x, r=r, put=put: F.when(x.rlike(r.needs), put(x)).otherwise(x)) if r.needs else put(c)
    return c


def reported(c: Column, rules: list[Rule]) -> Column:
    """The names of the rules that match in the text, in order; an empty array for a null text."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c.rlike(r.needs) & c.rlike(r.java()) if r.needs else c.rlike(r.java()), F.lit(False)), F.lit(r.name)) for r in rules)))


def sql(text: str, rules: list[Rule]) -> str:
    """The DuckDB expression of `apply`."""
    for r in rules:
        text = r.sql(text)
    return text
