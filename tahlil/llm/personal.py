"""Problem 5: personal data in free text, found by weak supervision and replaced by typed placeholders.

Labelers vote on every candidate span: regular expressions (shape), gazetteers (a given list of names, and the
names learned from the labelled lines of all forms) and context (labels and titles before, cues behind). The
candidates are found once and written with their votes and a few features of the span. Their patterns are
counted over all texts; expectation-maximisation over the vote patterns estimates how reliable each labeler is,
and its posteriors train the final classifier of spans, a logistic regression over votes and features. A
kind has at most 3^labelers x 2^features patterns, whatever the corpus.

Of the learned names and ordinary words at most NAMES_MOST go to all executors; where there are more, a text's
other words come to it by a join, so that the result doesn't depend on the bound.

Texts are compared in their consistent form (problem 4), but places are those of the text as stored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tahlil.functions.frequent import chosen
from tahlil.functions.turkish import plain
from tahlil.llm.skeleton import PROTOTYPE, invisible, latin_words
from tahlil.session import spread, written

KINDS = ("name", "phone", "identity", "email", "address")
PLACEHOLDER = {"name": "[KISI]", "phone": "[TELEFON]", "identity": "[KIMLIK]", "email": "[EPOSTA]", "address": "[ADRES]"}
NAMES_MOST = 200_000  # most learned names and ordinary words that are sent to the executors
LEARNED_LEAST, LEARNED_SHARE, COMMON_LEAST = 2, 0.12, 12
NAME_WORDS = 4  # most words of a name in a labelled line

# Labels, titles and cues, folded (fixed values).
FORM_LABELS = r"(?:hasta\s+adi\s+soyadi|hasta\s+adi|hastanin\s+adi|adi\s+soyadi|ad\s+soyad|adi|isim|hasta|refakatci|yakini|gonderen|imza|patolog|doktor|hekim|dr)\s*[:=]+\s*|(?:patolog|doktor|hekim|dr\.?)\s+"
TITLES = r"(?:(?:prof|doc|uzm|op|asist|yrd|pat|ars|gor|dr|ogr|uye)\s*\.?\s*){1,4}"
ROLES = r"ogl|kizi|esi|annesi|babasi|kardesi|yakini|refakatci|veren|adi|ornegini|aranacak|hemsire|sayin|bay|bayan"
AFTER = r"bey|hanim|adina|aldi|teslim|randevuyu|tarafindan|aranabilir|diye|onam|ile|ikamet|olguyu|ev\s+adresi|imzaladi"
STOP = frozenset("yas yasi tarih dogum protokol kabul tc tckn kimlik no tel gsm adres ev sira iletisim e posta bey hanim adina aldi teslim randevuyu tarafindan aranabilir diye onam ile in un ikamet olguyu hasta hastanesi dr patolog tani sonuc on ek".split())
NOT_NAMES = frozenset("gleason breslow fuhrman clark hodgkin burkitt ewing paget crohn barrett wilms giemsa papanicolaou nottingham bloom richardson ziehl neelsen masson congo kaposi merkel sertoli leydig langerhans schwann purkinje hurthle warthin brenner".split())
PLACE_WORDS = frozenset("hastanesi hastane merkezi laboratuvari universitesi universite klinigi koyu mahallesi mah caddesi cad sokak sok sk bulvari bulv bolge".split())
CODES = r"(?:barkod\w*|parti(?:\s+no)?|protokol(?:\s+no)?|lot(?:\s+no)?|seri(?:\s+no)?|blok(?:\s+no)?|sira|dosya(?:\s+no)?|rapor\s+no|cihaz\s+kodu)\s*[:=]?\s*"

ODD = re.compile(r"[^\x00-\x7FçğıöşüÇĞİÖŞÜ]")
WORD = re.compile(r"[^\W\d_]+(?:(?:-\n?|')[^\W\d_]+)*")
RUN = re.compile(r"[^\W\d_]+")
IDENTITY = re.compile(r"(?<![^\W_])[1-9](?:[ \n.\-]{0,2}\d){10}(?![^\W_])")
PHONE = re.compile(r"(?<![^\W_])(?:(?:\+\s?90|0090|90)[ \n.\-]{0,2}(?:\(0?[2-5]\d\d\)|[2-5]\d\d)|0[ ]?\([2-5]\d\d\)|\(0?[2-5]\d\d\)|0[ .\-]?[2-5]\d\d|(?<!\d)[2-5]\d\d(?=[-. ]\d{3}[-. ]\d{4}))[ \n./\-]{0,2}\d{3}[ \n.\-]{0,2}\d{2}[ \n.\-]{0,2}\d{2}(?!\d|[ .-]?\d{3})")
EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+-]*\s{0,2}(?:@|\[\s*at\s*\]|\(\s*at\s*\)|\{at\})\s{0,2}[\w-]+(?:\.[\w-]+)*?\s{0,2}(?:\.|\[\s*nokta\s*\]|\(\s*nokta\s*\))\s{0,2}[^\W\d_]{2,}(?:\.[^\W\d_]{2,})*", re.IGNORECASE)
STREET = r"(?:caddesi|cadde|cad\.?|sokagi|sokak|sok\.?|sk\.?|bulvari|bulv\.?|blv\.?)(?![^\W\d_])"
QUARTER = r"(?:mahallesi|mah\.?|mh\.?)(?![^\W\d_])"
NAME1 = r"[^\W\d_]{2,}(?:-\n[^\W\d_]+)?"
UNIT = r"(?:[,\s]{0,3}(?:no\s*[:.]?\s*\d+(?:\s*/\s*\d+)?|daire\s*[:.]?\s*\d+|kat\s*[:.]?\s*\d+|d\s*[:.]\s*\d+|k\s*[:.]\s*\d+|\d{1,4}(?:/\d+)?(?!\d|\.\d)))"
LINE_STARTS = "protokol|kabul|tarih|gsm|tel|iletisim|tckn|kimlik|dogum|makro|mikro|bulgu|oyku|yorum|klinik|tani|sonuc|ev:"
ADDRESS = re.compile(rf"(?<![^\W_])(?:{NAME1}\s+{QUARTER}\s*(?:(?:{NAME1}|\d+\.)\s+{STREET})?|(?:{NAME1}|\d{{1,4}}\.)\s+{STREET}){UNIT}*(?:,?[ \t]*(?:\s|\n)[ \t]*(?!adres|olarak|{LINE_STARTS}){NAME1})?")


AT = re.compile(r"[\[({]\s*at\s*[\])}]", re.IGNORECASE)
ANCHOR = re.compile(r"(?<=\s)(?:mah|mh|cad|sok|sk|bul|blv)")


def addresses(folded: str) -> Iterator[re.Match]:
    """The matches of ADDRESS, which are looked for only where a word for a quarter or street has a word before it."""
    done = 0
    for a in ANCHOR.finditer(folded):
        if a.start() < done:
            continue
        end = a.start()
        while end > done and folded[end - 1].isspace():
            end -= 1
        begin = end - 1 if folded[end - 1 : end] == "." else end
        if begin < end:
            while begin > done and folded[begin - 1].isdigit():
                begin -= 1
            starts = [begin]
        else:
            while begin > done and folded[begin - 1].isalpha():
                begin -= 1
            starts = [begin]
            if folded[max(0, begin - 2) : begin] == "-\n":
                first = begin - 2
                while first > done and folded[first - 1].isalpha():
                    first -= 1
                starts = [first, begin]
        if m := next((m for s in starts if (m := ADDRESS.match(folded, s))), None):
            done = m.end()
            yield m


def normal(text: str) -> tuple[str, list[int] | None]:
    """The text in consistent form, and the place of each of its characters in the text (None: the same)."""
    if not ODD.search(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    done = 0
    for m in ODD.finditer(text):
        i, c = m.start(), m.group()
        if i > done:
            out.append(text[done:i])
            at.extend(range(done, i))
        done = i + 1
        if ord(c) >= 0x300 and unicodedata.combining(c):
            if out:
                last = out[-1][-1]
                one = unicodedata.normalize("NFC", last + c)
                out[-1] = out[-1][:-1] + (one if len(one) == 1 else "i" if last in "iı" and c == "\u0307" else last)
        elif not invisible(c):
            out.append(PROTOTYPE.get(c, c))
            at += [i] * len(out[-1])
    out.append(text[done:])
    at.extend(range(done, len(text)))
    return latin_words("".join(out)), at


class Lexicon:
    """Given and learned names, and ordinary words; all folded."""

    def __init__(self, first: set[str], last: set[str], learned: set[str], common: set[str]):
        self.first, self.last, self.learned, self.common = first, last, learned, common
        self.given_names = first | last
        self.names = (self.given_names | learned) - NOT_NAMES
        self.asked: dict[str, bool] = {}

    def extended(self, more: list) -> Lexicon:
        """The lexicon with more words (word, learned, common), for one text."""
        if not more:
            return self
        return Lexicon(self.first, self.last, self.learned | {w["word"] for w in more if w["learned"]}, self.common | {w["word"] for w in more if w["common"]})

    def known(self, w: str) -> bool:
        """Whether all parts of a folded word are names, given or learned."""
        if w.isalpha():
            return w in self.names
        if (k := self.asked.get(w)) is None:
            if len(self.asked) > 500_000:
                self.asked.clear()
            k = self.asked[w] = self._known(w)
        return k

    def _known(self, w: str) -> bool:
        parts = [p for p in re.split(r"[-\n]+", w) if p]
        return bool(parts) and (all(p in self.given_names or p in self.learned for p in parts) or "".join(parts) in self.given_names | self.learned) and not any(p in NOT_NAMES for p in parts)

    def given(self, w: str) -> bool:
        """Whether a part of a folded word is a given name."""
        return w in self.given_names if w.isalpha() else any(p in self.given_names for p in re.split(r"[-\n]+", w))


LABELLED = re.compile(rf"(?:^|\n)[ \t]*(?:{FORM_LABELS})(?:{TITLES})?(?=[^\W\d_])")


TITLED = re.compile(rf"(?<![^\W_]){TITLES}(?=[^\W\d_])")
ROLED = re.compile(rf"(?<![^\W_])(?:{ROLES}\w{{0,2}})\s*[:=]*\s+(?=[^\W\d_])|(?:aranacak|refakatci)\s*:\s*")


def labelled_names(text: str, folded: str) -> Iterator[str]:
    """Folded words that stand as names in the labelled lines of a form."""
    for m in LABELLED.finditer(folded):
        end = folded.find("\n", m.end())
        for n, w in enumerate(WORD.finditer(folded, m.end(), end if end >= 0 else len(folded))):
            if n == NAME_WORDS or w.group() in STOP or (w.end() < len(folded) and folded[w.end()] in ":="):
                break
            if text[w.start()].isupper() or not re.search(r"[A-ZÇĞİÖŞÜ]", text[m.end() : end if end >= 0 else len(text)]):
                yield from (p for p in re.split(r"[-\n']+", w.group()) if len(p) > 2)
            else:
                break


def word_stats(texts: DataFrame) -> DataFrame:
    """(word, named, n, low): how often each word stands as a name in a labelled line, at all, and in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, written_as = Counter(), Counter()
            for text in b.column(0).to_pylist():
                form, _ = normal(text)
                named.update(labelled_names(form, plain(form)))
                written_as.update(RUN.findall(form))
            n, low = Counter(), Counter()
            for w, k in written_as.items():
                if len(w) > 2:
                    n[f := plain(w)] += k
                    if w[0].islower():
                        low[f] += k
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (named, n, low))], names=["word", "named", "n", "low"])

    return texts.select("text").mapInArrow(run, "word string, named long, n long, low long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("named", "n", "low")))


def cased(word: str) -> bool:
    """Whether a word begins with a capital."""
    return word[0].isupper()


# What stands before and behind a span, and between the words of a name.
PERSON_TITLE = re.compile(r"(?:dr|prof|doc|uzm|asist|patolog)\W*$")
NAME_GAP, INITIAL_GAP, AFTER_INITIAL = re.compile(r"[ \t]+|[ \t]*\n[ \t]*"), re.compile(r"\.\s{0,2}\n?"), re.compile(r"\.[ \t]*\n?[ \t]*")
BEHIND = re.compile(rf"\s*(?:{AFTER})(?![^\W_])|'[iu]n\s+ikamet|\s*[,]\s*(?:ev\s+adresi|olguyu)|\s*/\s*[{{\d+(]|\s*\(\W*\d")
PLACE_BEHIND = re.compile(r"\s+(?:" + "|".join(sorted(PLACE_WORDS)) + r")(?![^\W_])")
CODE_BEFORE = re.compile(rf"{CODES}$")
IDENTITY_BEFORE, IDENTITY_BEHIND = re.compile(r"(?:kimlik(?:\s+belgesi)?|tckn|t\.?\s?c\.?|kaydinda|\bno)\W*(?:no\W*)?$"), re.compile(r"\s*(?:\)|gorunen)")
PHONE_BEFORE = re.compile(r"(?:tel|telefon|gsm|cep|iletisim|posta|hat|faks|ya\s+da|randevuyu|ile|aranabilir|aranacak)\W*$|/\s*$")
PHONE_BEHIND = re.compile(r"\)|\s*(?:uzerinden|numarasi|dogum|/|\.)")
EMAIL_BEFORE, EMAIL_BEHIND = re.compile(r"(?:posta|yazisma|iletisim|sonuclarin|/)\W*$"), re.compile(r"\s*(?:adresine|,|\.|ya\s+da|$)")
ADDRESS_BEFORE, ADDRESS_BEHIND = re.compile(r"(?:adres\w*|ev|ekibi|fatura)\W*$"), re.compile(r"\W*(?:adres\w*|olarak|$)")
PLACE_PART = re.compile(rf"{QUARTER}|{STREET}")


def name_candidates(form: str, folded: str, lex: Lexicon) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """Runs of words that may be one person's name: (begin, end, votes)."""
    words = [m.span() for m in WORD.finditer(folded)]
    labels = {m.end() for m in LABELLED.finditer(folded)}
    titles = {m.end() for m in TITLED.finditer(folded) if PERSON_TITLE.search(m.group())}
    roles = {m.end() for m in ROLED.finditer(folded)}
    # where a name may begin: at a known word, one put together, an initial, or behind a label, title or role
    names, starts = lex.names, [a for a, _ in words]
    some = {k for k, (a, b) in enumerate(words) if (w := folded[a:b]) in names or len(w) == 1 or not w.isalpha()}
    some |= {k for x in labels | titles | roles if (k := bisect_left(starts, x)) < len(starts) and starts[k] == x}
    i = 0
    for at in sorted(some):
        if at < i:
            continue
        i = at
        begin, end = words[i]
        raw = form[begin:end].split("'")[0]
        end = begin + len(raw)
        key = folded[begin:end]
        left = begin in labels or begin in titles
        role = begin in roles
        initial = len(raw) == 1 and raw.isupper() and form[end : end + 1] == "."
        if initial and i + 1 < len(words) and INITIAL_GAP.fullmatch(form[end : words[i + 1][0]]):
            follow = folded[words[i + 1][0] : words[i + 1][1]].split("'")[0]
            fits = lex.known(follow) or ((left or role) and follow not in lex.common and follow not in STOP)
        else:
            initial, fits = False, lex.known(key) or ((left or role) and len(raw) > 1 and cased(raw) and key not in lex.common and key not in STOP and key not in PLACE_WORDS)
        if not fits:
            continue
        run, j, closed = [key], i + 1, "'" in form[begin : words[i][1]]
        stop_at = 5
        while j < len(words) and len(run) < stop_at and not closed:
            gap = form[end : words[j][0]]
            if not (NAME_GAP if not (initial and len(run) == 1) else AFTER_INITIAL).fullmatch(gap) or (gap.count("\n") and left and begin in labels and lex_line(form, begin)):
                break
            nxt = form[words[j][0] : words[j][1]]
            bare = nxt.split("'")[0]
            k = folded[words[j][0] : words[j][0] + len(bare)]
            if k in STOP or not (lex.known(k) or ((left or role) and cased(bare) and k not in lex.common and k not in PLACE_WORDS)):
                break
            if "\n" in gap and (words[j][0] in labels or form[words[j][1] : words[j][1] + 1] in ":="):
                break
            run.append(k)
            end, closed = words[j][0] + len(bare), "'" in nxt
            j += 1
        tail = folded[end : end + 24]
        right = bool(BEHIND.match(tail))
        place = bool(PLACE_BEHIND.match(tail))
        title_case = all(cased(form[a:b]) for a, b in words[i:j])
        if initial:
            run = run[1:]
        lone = len(run) == 1 and not initial
        votes = (
            1 if any(lex.given(w) for w in run) and not lone else 0,
            1 if run and all(lex.known(w) for w in run) and not lone else (0 if run and all(lex.known(w) for w in run) else -1),
            1 if left or role else 0,
            1 if right else 0,
            1 if title_case and not lone else (-1 if not title_case and lone else 0),
            -1 if lone and not (left or role or right) else 0,
            -1 if place or any(w in NOT_NAMES for w in run) else 0,
        )
        if run:
            yield begin, end, votes
        i = max(j, i + 1)


def lex_line(form: str, begin: int) -> bool:
    """Whether the label before `begin` opens its line (then the name ends with the line)."""
    start = form.rfind("\n", 0, begin) + 1
    return begin - start < 40


def candidates(form: str, folded: str, lex: Lexicon) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """Every candidate span with the votes of its kind's labelers."""
    for begin, end, votes in name_candidates(form, folded, lex):
        yield "name", begin, end, votes
    for m in IDENTITY.finditer(form):
        n = re.sub(r"\D", "", m.group())
        before = folded[max(0, m.start() - 26) : m.start()]
        code = CODE_BEFORE.search(before)
        label = IDENTITY_BEFORE.search(before)
        paren = before.endswith("(") or IDENTITY_BEHIND.match(folded[m.end() : m.end() + 10])
        solid = len(re.findall(r"[^\d]+", m.group())) <= 4
        yield "identity", m.start(), m.end(), (1 if solid else 0, 1 if label else 0, 1 if paren else 0, -1 if code else 0, 1 if n[0] != "0" and len(n) == 11 else -1, -1 if re.search(r"\n.*\n", m.group()) or re.search(r"\d{2}\.\d{2}\.\d{4}", m.group()) else 0)
    for m in PHONE.finditer(form):
        before, after = folded[max(0, m.start() - 26) : m.start()], folded[m.end() : m.end() + 18]
        code = CODE_BEFORE.search(before)
        label = PHONE_BEFORE.search(before)
        cue = PHONE_BEHIND.match(after)
        grouped = len(re.findall(r"[^\d]+", m.group().strip("+("))) >= 1
        yield "phone", m.start(), m.end(), (1 if label else 0, 1 if cue else 0, -1 if code else 0, 1 if grouped else 0)
    for m in EMAIL.finditer(form) if "@" in form or AT.search(form) else ():
        before, after = folded[max(0, m.start() - 16) : m.start()], folded[m.end() : m.end() + 14]
        yield "email", m.start(), m.end(), (1, 1 if EMAIL_BEFORE.search(before) else 0, 1 if EMAIL_BEHIND.match(after) else 0, 1 if re.search(r"\.|nokta", m.group().split("@")[-1], re.IGNORECASE) else -1)
    for m in addresses(folded):
        before, after = folded[max(0, m.start() - 18) : m.start()], folded[m.end() : m.end() + 14]
        text = m.group()
        yield "address", m.start(), m.end(), (1 if re.search(r"\d", text) else -1, 1 if ADDRESS_BEFORE.search(before) else 0, 1 if ADDRESS_BEHIND.match(after) else 0, 1 if PLACE_PART.search(text) else -1)


#: How much a labeler is trusted before its reliability is estimated (the chance that it is right when it votes), and the share of true spans.
TRUST = {
    "name": ((0.9, 0.9, 0.9, 0.85, 0.7, 0.9, 0.95), 0.6),
    "identity": ((0.7, 0.95, 0.9, 0.95, 0.7, 0.95), 0.7),
    "phone": ((0.9, 0.8, 0.98, 0.8), 0.5),
    "email": ((0.9, 0.9, 0.8, 0.95), 0.9),
    "address": ((0.85, 0.95, 0.9, 0.9), 0.7),
}


ANCHOR_WEIGHT = 200.0  # votes that what is trusted at the start counts as; the corpus outweighs it


def reliabilities(kind: str, patterns: Counter, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over vote patterns: the chance that each labeler is right when it votes, with the share of true
    spans, which is a given parameter. Votes count as independent given the truth, and not to vote says nothing. What is trusted
    at the start counts as a fixed number of votes (it names which of the two classes is the true one); beyond some hundred
    candidates the corpus decides. The share is not estimated: where most candidates are true, it would outvote a labeler that
    alone speaks against a span."""
    trust, share = np.array(TRUST[kind][0]), TRUST[kind][1]
    if not patterns:
        return trust, share
    votes = np.array(list(patterns), float)
    n = np.array(list(patterns.values()), float)
    start = trust.copy()
    for _ in range(rounds):
        q = posterior(votes, trust, share)
        right = (n * q) @ (votes > 0) + (n * (1 - q)) @ (votes < 0)
        trust = np.clip((right + ANCHOR_WEIGHT * start) / (n @ np.abs(votes) + ANCHOR_WEIGHT), 0.55, 0.995)
    return trust, share


def posterior(votes: np.ndarray, trust: np.ndarray, share: float) -> np.ndarray:
    """The chance that spans with these votes are true."""
    z = log(share / (1 - share)) + votes @ np.log(trust / (1 - trust))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def trained(kind: str, patterns: Counter, rounds: int = 400) -> dict[tuple, float]:
    """The score of every pattern (votes, features) by the final classifier, a logistic regression over both that is fitted to the
    posteriors of the votes."""
    if not patterns:
        return {}
    size = len(TRUST[kind][0])
    by_votes: Counter = Counter()
    for p, k in patterns.items():
        by_votes[p[:size]] += k
    trust, share = reliabilities(kind, by_votes)
    x = np.array([(*p, 1.0) for p in patterns])
    n = np.sqrt(np.array(list(patterns.values()), float))
    n /= n.sum()
    y = posterior(x[:, :size], trust, share)
    weights = np.concatenate([np.log(trust / (1 - trust)), np.zeros(x.shape[1] - size - 1), [log(share / (1 - share))]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        weights += 2.0 * (x.T @ (n * (y - p)) - 1e-4 * np.append(weights[:-1], 0))
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
    return dict(zip(patterns, p.tolist(), strict=True))


def features(form: str, begin: int, end: int) -> tuple[int, ...]:
    """Features of a span beyond its votes: one word, over a line's end, at the beginning of a line, in capitals."""
    span = form[begin:end]
    return (0 if " " in span.strip() else 1, int("\n" in span), int(not begin or form[begin - 1] == "\n"), int(span.isupper()))


TAG_END = re.compile(r"_S[Iİ]L[Iİ]ND[Iİ]\]")


def voted(text: str, lex: Lexicon) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, pattern) of the candidates of a text, places as stored; what stands within a mask tag is none."""
    form, at = normal(text)
    out = []
    for kind, begin, end, votes in candidates(form, plain(form), lex):
        if "[" in form and TAG_END.search(form[begin : end + 10].split("]")[0] + "]"):
            continue
        pattern = ",".join(map(str, (*votes, *features(form, begin, end))))
        out.append((kind, begin, end, pattern) if at is None else (kind, at[begin], at[end - 1] + 1, pattern))
    return out


ORDER = {"email": 0, "phone": 1, "identity": 2, "address": 3, "name": 4}


def decided(some: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of spans with scores those that are true, without overlaps: an earlier kind of sure shape (email, phone, identity) goes
    before address and name. In order of place."""
    begins: list[int] = []
    taken: list[tuple[int, int]] = []
    out = []
    for s in sorted((s for s in some if s[3] >= 0.5), key=lambda s: (ORDER[s[0]], s[1])):
        i = bisect_left(begins, s[1])
        if (i == len(taken) or s[2] <= taken[i][0]) and (i == 0 or taken[i - 1][1] <= s[1]):
            begins.insert(i, s[1])
            taken.insert(i, s[1:3])
            out.append(s)
    return sorted(out, key=lambda s: s[1])


def redact(text: str, some: list[tuple[str, int, int, float]]) -> str:
    """The text with a placeholder of the right type for each span, the rest unchanged; spans in order of place."""
    out, done = [], 0
    for kind, begin, end, _ in some:
        out += [text[done:begin], PLACEHOLDER[kind]]
        done = end
    return "".join(out) + text[done:]


def texts(ocr: DataFrame, cases: DataFrame, ner: DataFrame) -> DataFrame:
    """(tbl, rec_key, text) of the three tables; null texts are left out."""
    parts = ((ocr, "ocr_result", "ocr_id"), (cases, "synth_case", "id"), (ner, "ner_result", "ner_id"))
    out = [df.select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("rec_key"), "text") for df, t, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).filter("text is not null")


def lexicon(some: DataFrame, names: DataFrame) -> tuple[tuple[set, set, set, set], DataFrame | None]:
    """Given names, learned names and ordinary words; and the words (word, learned, common) beyond those that are sent, None if
    there are none. The list of given names is refused beyond NAMES_MOST rows."""
    stats = written(word_stats(some), "word-stats")
    learned = (F.col("named") >= LEARNED_LEAST) & (F.col("named") >= LEARNED_SHARE * F.col("n"))
    common = (F.col("n") >= COMMON_LEAST) & ((F.col("named") < LEARNED_SHARE * F.col("n")) | (F.col("low") > 0.5 * F.col("n")))
    told = stats.select("word", learned.alias("learned"), common.alias("common"), "n").filter("learned or common")
    keep = chosen(told, "n", NAMES_MOST, "word")
    sent, size = told.filter(keep).collect(), told.count()
    given = names.filter("token is not null").limit(NAMES_MOST + 1).collect()
    if len(given) > NAMES_MOST:
        raise ValueError(f"the list of names has more than {NAMES_MOST} rows")
    lex = ({plain(r.token) for r in given if r.is_first}, {plain(r.token) for r in given if r.is_surname}, {r.word for r in sent if r.learned}, {r.word for r in sent if r.common})
    return lex, (told.filter(~keep).drop("n") if size > len(sent) else None)


def with_words(some: DataFrame, rest: DataFrame | None) -> DataFrame:
    """`some` with `more_words`: of a text's words those of `rest`. Without a rest nothing is exchanged."""
    if rest is None:
        return some.withColumn("more_words", F.lit(None).cast("array<struct<word:string,learned:boolean,common:boolean>>"))
    some = written(some.withColumn("__row", F.monotonically_increasing_id()), "personal-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in parts_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["__row", "word"])

    need = some.select("__row", "text").mapInArrow(run, "__row long, word string").join(rest.hint("merge"), "word")
    need = need.groupBy("__row").agg(F.collect_list(F.struct("word", "learned", "common")).alias("more_words"))
    return some.join(need.hint("merge"), "__row", "left").drop("__row")


def parts_of(text: str) -> set[str]:
    """The folded words of a text, as they are looked up: whole, without hyphens, and by their parts."""
    folded = plain(normal(text)[0])
    return {p for m in WORD.finditer(folded) for w in (m.group(), m.group().split("'")[0]) for p in (w, *re.split(r"[-\n]+", w), re.sub(r"[-\n]+", "", w)) if p}


FOUND = "tbl string, rec_key string, spans array<struct<kind:string,start_at:bigint,end_at:bigint,score:double>>"
SPAN = pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("score", pa.float64())])


def scored(some: DataFrame, names: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, object]:
    """The candidates of all texts, found once and written (tbl, rec_key, `cands`, and the columns to keep); and the broadcast
    scores of their patterns."""
    lex, rest = lexicon(some, names)
    held = some.sparkSession.sparkContext.broadcast(lex)
    cand = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("pattern", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*held.value)
        for b in batches:
            got = [voted(t, own.extended(more)) for t, more in zip(b.column("text").to_pylist(), b.column("more_words").to_pylist(), strict=True)]
            lists = pa.array([[dict(zip(("kind", "start_at", "end_at", "pattern"), s, strict=True)) for s in g] for g in got], cand)
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("rec_key"), *(b.column(c) for c in keep), lists], names=["tbl", "rec_key", *keep, "cands"])

    schema = "tbl string, rec_key string, " + "".join(f"{c} string, " for c in keep) + "cands array<struct<kind:string,start_at:bigint,end_at:bigint,pattern:string>>"
    every = written(with_words(some, rest).select("tbl", "rec_key", "text", "more_words").mapInArrow(run, schema), "personal-spans")
    counts: dict[str, Counter] = {k: Counter() for k in KINDS}
    for r in every.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.pattern").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.kind][tuple(map(int, r.pattern.split(",")))] = r.n
    scores = {(k, ",".join(map(str, p))): v for k in KINDS for p, v in trained(k, counts[k]).items()}
    return every, some.sparkSession.sparkContext.broadcast(scores)


def decide(b: pa.RecordBatch, scores: dict) -> list[list[tuple[str, int, int, float]]]:
    """The spans of each row of a batch."""
    return [decided([(c["kind"], c["start_at"], c["end_at"], scores[c["kind"], c["pattern"]]) for c in some]) if some else [] for some in b.column("cands").to_pylist()]


def span_lists(got: list) -> pa.Array:
    """Spans as an array of lists of structs."""
    return pa.array([[dict(zip(("kind", "start_at", "end_at", "score"), s, strict=True)) for s in g] for g in got], pa.list_(SPAN))


def located(some: DataFrame, names: DataFrame) -> DataFrame:
    """(tbl, rec_key, `spans`) of the personal data in each text; see `masked`."""
    every, held = scored(spread(some), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("rec_key"), span_lists(decide(b, held.value))], names=["tbl", "rec_key", "spans"])

    return every.mapInArrow(run, FOUND)


def masked(some: DataFrame, names: DataFrame) -> DataFrame:
    """(tbl, rec_key, text) with the `spans` found in each text and the `masked` text.

    An empty text has no spans. Repeated rows stay repeated. `names`: token, is_first, is_surname; it may be
    empty, then names are known by labels and learned names alone. A very long text is handled whole.
    """
    every, held = scored(spread(some), names, ("text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = decide(b, held.value)
            new = pa.array([redact(t, g) for t, g in zip(b.column("text").to_pylist(), got, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("rec_key"), span_lists(got), new], names=["tbl", "rec_key", "spans", "masked"])

    return every.mapInArrow(run, f"{FOUND}, masked string")


def found(done: DataFrame) -> DataFrame:
    """(tbl, rec_key, kind, start_at) of every occurrence."""
    return done.select("tbl", "rec_key", F.explode("spans").alias("s")).select("tbl", "rec_key", "s.kind", "s.start_at")
