"""Lookup of freely typed terms in a reference list, within a bounded edit distance.

The reference list is kept as a symmetric-delete dictionary: every form of every term under all strings that
arise by deleting up to two of its characters. A typed value is looked up by its own deletions, so a lookup
costs the same whatever the length of the list. Candidates are ranked by weighted Damerau-Levenshtein
distance, then by how often the term occurs in its reference form, then by id.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from itertools import combinations

from tahlil.functions.turkish import plain

#: Most forms of a list that is sent to the executors whole.
FORMS_MOST = 20_000
#: Pairs of characters that are read or typed for one another (fixed values); replacing one costs less.
ALIKE = {frozenset(p) for p in ("1l", "1i", "il", "0o", "5s", "8b", "2z", "6g", "9g", "mn", "uv", "ck")}
#: Words of specimen and method added to a term that do not change which entry is meant, folded (fixed values); a caller may give
#: others.
ADDED = frozenset("serum plazma kan idrar boyasi boyama duzeyi seviyesi degeri testi olcumu immun ihk".split())
#: Endings that a term may carry in a sentence, folded (fixed values).
ENDINGS = ("nda", "nde", "da", "de", "ta", "te", "dan", "den", "nin", "nun", "in", "un", "yu", "yi", "i", "u")
GRADES = frozenset(("grade", "derece", "evre"))
ROMAN_OR_DIGIT = re.compile(r"(?:i{1,3}|iv|\d+)")


def allowed(key: str) -> int:
    """Edits allowed for a form: none up to four letters, one up to eight, two beyond."""
    letters = sum(c.isalpha() for c in key)
    return 0 if letters <= 4 else 1 if letters <= 8 else 2


def deletes(key: str, most: int) -> set[str]:
    """The strings that arise by deleting up to `most` characters."""
    return {"".join(c for i, c in enumerate(key) if i not in gone) for n in range(most + 1) for gone in map(set, combinations(range(len(key)), n))}


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (swaps of neighbours cost 1), or infinity beyond `most`.

    Doubling a letter or leaving one of a double out costs 0.8, replacing a look-alike 0.4, any other edit 1.
    Digits stand for themselves: only a look-alike may replace one.
    """
    if abs(len(a) - len(b)) > most / 0.8:
        return float("inf")
    before, row = None, [0.0]
    for y in b:
        row.append(row[-1] + 1)
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            out_x = 9.0 if x.isdigit() else 0.8 if i > 1 and a[i - 2] == x else 1.0
            out_y = 9.0 if y.isdigit() else 0.8 if j > 1 and b[j - 2] == y else 1.0
            swap = 0.0 if x == y else 0.4 if frozenset((x, y)) in ALIKE else 9.0 if x.isdigit() or y.isdigit() else 1.0
            cost = min(row[j] + out_x, new[j - 1] + out_y, row[j - 1] + swap)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y and not (x.isdigit() or y.isdigit()):
                cost = min(cost, before[j - 2] + 1.0)
            new.append(cost)
        before, row = row, new
        if min(row) > most:
            return float("inf")
    return row[-1] if row[-1] <= most else float("inf")


def tokens(value: str) -> list[str]:
    """The folded words and numbers of a value."""
    return re.findall(r"[^\W_]+", plain(value))


def joined(words: list[str]) -> str:
    """The key of some words: put together without separators."""
    return "".join(words)


def digits(key: str) -> str:
    """The key with the letters that are read for digits as digits."""
    return key.translate(str.maketrans("lio", "110"))


def stripped(words: list[str], added: frozenset[str] = ADDED) -> list[list[str]]:
    """The words without some of the added words at their beginning and end, the longest first. Behind an added word for a grade a
    number goes with it."""
    lead = 0
    while lead < len(words) - 1 and words[lead] in added:
        lead += 1
    tail, graded = len(words), any(w in GRADES & added for w in words)
    while tail - 1 > lead and (words[tail - 1] in added or graded and ROMAN_OR_DIGIT.fullmatch(words[tail - 1])):
        tail -= 1
    return [words[i:j] for i in range(lead + 1) for j in range(len(words), tail - 1, -1)]


class Terms:
    """A reference list of (id, term, aliases, frequency); entries without id or term, and empty aliases, are left out."""

    def __init__(self, entries: list[tuple[int, str, list[str], int]], added: frozenset[str] = ADDED):
        self.added = added
        entries = [e for e in entries if e[0] is not None and e[1]]
        self.terms = {t: i for i, t, _, _ in entries}
        self.frequency = {i: n for i, _, _, n in entries}
        self.exact: dict[str, int] = {}
        self.near: dict[str, set[tuple[str, int]]] = defaultdict(set)
        forms = [(form, i) for i, t, aliases, _ in entries for form in [t, *(aliases or [])] if form]
        if len(forms) > FORMS_MOST:
            raise ValueError(f"the reference list has {len(forms)} forms; at most {FORMS_MOST} are sent to the executors")
        for form, i in sorted(forms, key=lambda f: (-self.frequency[f[1]], f[1])):
            key = joined(tokens(form))
            self.exact.setdefault(key, i)
            if any(c.isdigit() for c in key):
                self.exact.setdefault(digits(key), i)
            for d in deletes(key, allowed(key)):
                self.near[d].add((key, i))
        self.match = lru_cache(100_000)(self._match)

    def candidates(self, value: str) -> list[tuple[str, float]]:
        """Keys that a value may stand for, each with the cost of getting there."""
        out: dict[str, float] = {}

        def add(words: list[str], cost: float) -> None:
            if words and (key := joined(words)):
                out[key] = min(cost, out.get(key, 9.0))

        bare = re.sub(r"[(\[][^)\]]*[)\]]", " ", value)
        for text, base in ((value, 0.0), (bare, 0.0), (re.split(r"[,;]|\s[-–]\s", bare)[0], 0.05)):
            for n, some in enumerate(stripped(tokens(text), self.added)):
                cost = base + (0.05 if n else 0.0)
                add(some, cost)
                if len(some) > 1:
                    add(some[1:] + some[:1], cost + 0.1)
                    add(some[-1:] + some[:-1], cost + 0.1)
                for e in ENDINGS:
                    if some and some[-1].endswith(e) and len(some[-1]) - len(e) >= 3:
                        add([*some[:-1], some[-1][: -len(e)]], cost + 0.15)
        return sorted(out.items(), key=lambda x: (x[1], x[0]))

    def _match(self, value: str) -> tuple[int, float]:
        if value in self.terms:
            return self.terms[value], 0.0
        keys = self.candidates(value)
        for key, cost in keys:
            for form in (key, digits(key)):
                if form in self.exact:
                    return self.exact[form], round(cost, 3)
        best = (float("inf"), 0, 0)
        for key, cost in keys:
            most = min(2, allowed(key) + 1)
            seen = set()
            for d in deletes(key, most):
                for form in self.near.get(d, ()):
                    if form not in seen:
                        seen.add(form)
                        limit = allowed(form[0])
                        found = distance(key, form[0], limit) if limit else float("inf")
                        best = min(best, (round(found + cost, 3), -self.frequency[form[1]], form[1]))
        return (best[2], best[0]) if best[0] < float("inf") else (0, -1.0)


