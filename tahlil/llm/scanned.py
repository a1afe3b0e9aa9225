"""Problem 6: text read from scanned pages, repaired into continuous paragraphs.

Page furniture (page numbers, repeated headings) is found by its place at a page's edge; words cut at a line's
end are put together across it, also across pages. Misread words are corrected by a noisy channel: the
probability that letters are read as other characters, times that of the word under a word bigram model of
the whole corpus, decoded by Viterbi over the candidates of the words of each line.

1. Each text is taken apart once: the kinds of its lines and their folded words are written.
2. Words and word pairs are counted over all texts. Words that may be read for one another meet by a key they have in
   common, so no candidate is missed, however long a word is; the rates of the channel are estimated from them.
3. A word without candidates is sure, and cuts the Viterbi path of its line. So what is decoded is each distinct
   stretch of unsure words with its two neighbours, once, however often it stands.
4. What changed goes back to its texts by the stretch.

The most frequent WORDS and PAIRS (a fixed bound) go to all executors; what a stretch needs of the others comes to it
by joins, so the result doesn't depend on the bound. A word that stands nowhere else has a probability by its
characters; a pair of words that stands only once says nothing, as it is the one at hand.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from copy import copy
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tahlil.functions.frequent import chosen
from tahlil.functions.turkish import lower, plain
from tahlil.llm.skeleton import skeleton
from tahlil.session import made, spread, written

WORDS, PAIRS = 50_000, 100_000  # most entries of the language model that is sent
SENT_CHARS, SENT_OPTIONS = 40, 16  # most characters and candidates of a word in it
FILTER_BITS = 1 << 24  # size of the filter of unsure words
# What is read for which letters (fixed values); folded.
CONFUSIONS = (
    ("1", "l"), ("1", "ı"), ("1", "i"), ("!", "i"), ("!", "ı"), ("@", "a"), ("4", "a"), ("0", "o"), ("5", "s"), ("$", "ş"), ("$", "s"), ("2", "z"),
    ("6", "g"), ("6", "b"), ("9", "g"), ("8", "b"), ("3", "e"), ("7", "t"), ("|", "l"), ("|", "ı"), ("€", "e"),
    ("c", "e"), ("f", "e"), ("l", "ı"), ("rn", "m"), ("ri", "n"), ("rı", "n"), ("cl", "d"), ("lc", "k"), ("ii", "u"), ("li", "u"), ("lı", "u"), ("ıı", "u"), ("vv", "w"),
)
SIGNS = "0123456789!@$|€"
BY_FIRST = {c: tuple(u for u in CONFUSIONS if u[0][0] == c) for c in {seen[0] for seen, _ in CONFUSIONS}}
# One spelling for all letters and signs that may be read for one another by CONFUSIONS.
KEY = str.maketrans(
    {"m": "rri", "n": "ri", "u": "ii", "d": "ei", "k": "ie", "w": "vv"}
    | {c: to for cs, to in (("cf3€", "e"), ("lı1!|", "i"), ("@4", "a"), ("0", "o"), ("5$ş", "s"), ("2", "z"), ("69b8", "g"), ("7", "t")) for c in cs}
)
START_RATE = 0.003  # how often a confusion happens, before it is estimated
LAMBDA, UNKNOWN = 0.4, 0.02
RATIO_SIGNS, RATIO_LETTERS = 4, 30  # how many times as frequent a word must be to explain all of its misreadings
PAGE_NO = re.compile(r"[-–\[(\s]{0,2}(?:(?:sayfa|sf|s)\s*[.:]?\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?[-–\]\s]{0,2}", re.IGNORECASE)
MARKS = "-‐‑=¬"
BARE = re.compile(r"\d{1,4}(?:\s*/\s*\d{1,4})?")
BROKEN = re.compile(r"[^\W\d_](?:[-‐‑=]|¬)\s*$")
PIECE = re.compile(rf"[^\W_{SIGNS}]*(?:[^\W_]|[!@$|€](?=[^\W_]|$)|[!@$|€]+(?=[^\W_]))[\w!@$|€]*")
BARE_WORD = re.compile(r"[^\W_]\w*")  # what PIECE finds where a line has no signs
SIGN = re.compile(f"[{re.escape(SIGNS)}]")
READING = re.compile(r"[^\W\d_]{2,}(?:[ -]?\d+(?:-\d+)?)?")


def page_parts(text: str, other: str | None = None) -> tuple[list[str], list[str], tuple[str, str]]:
    """The lines of a text, the kind of each (body, blank, page_no, header), and its heading.

    A heading is the first two lines that are no page number. That of the `other` reading stands in for a text that has none
    of its own, such as a reading of only some of the pages; it is looked for only where a line may repeat it.
    """
    lines = text.split("\n")
    kinds = ["blank" if not line.strip() else "body" for line in lines]
    edge = [k == "blank" for k in kinds]
    for i, line in enumerate(lines):
        s = line.strip()
        if kinds[i] == "body" and PAGE_NO.fullmatch(s):
            before, after = (i == 0 or edge[i - 1]), (i + 1 == len(lines) or edge[i + 1] or no_text(lines[i + 1]))
            if BARE.fullmatch(s) and (not (before or after) or not before and READING.fullmatch(lines[i - 1].strip())):
                continue  # a number in the text, or the value of a reading
            kinds[i] = "page_no"
    body = [i for i, k in enumerate(kinds) if k == "body"]
    own = tuple(lines[i].strip() for i in body[:2]) if len(body) > 1 else ("", "")
    heads = [own] if own[0] else []
    for i in body[2:]:
        if i and kinds[i - 1] in ("blank", "page_no", "header") and "blank" in kinds[max(0, i - 3) : i]:
            if other and not any(repeats(lines[i].strip(), h) for h in heads):
                second, other = heading_of(other), None
                heads += [second] if second and second[0] else []
            if any(repeats(lines[i].strip(), h) for h in heads):
                kinds[i] = "header"
    return lines, kinds, own


def no_text(line: str) -> bool:
    """Whether a line is one endless string without words."""
    return len(line) > 80 and " " not in line.strip()


@lru_cache(20_000)
def repeats(line: str, head: tuple[str, str]) -> bool:
    """Whether a line repeats a heading, alone or with page or patient."""
    x, (name, title) = plain(line), map(plain, head)
    bare = re.sub(r"\s*[-|,]?\s*(?:s\w{1,2}fa|sf|s)\s*[.:]?\s*\d+\s*(?:/\s*\d+)?\s*$", "", x)
    paged = bare != x
    forms = [title, f"{name} - {title}", f"{name} {title}", f"{name} | {title}"] + ([name] if paged or len(name) > 14 else [])
    if x.count("|") == 1 and x.startswith(("hasta", "ad")):
        bare, forms = x.split("|")[1].strip(), [title]
    return any(abs(len(bare) - len(f)) <= 6 and len(f) > 6 and SequenceMatcher(None, bare, f, False).ratio() >= 0.82 for f in forms)


def tokens(line: str) -> list[str]:
    """The words of a line."""
    return PIECE.findall(line) if SIGN.search(line) else BARE_WORD.findall(line)


def words(lines: list[str], kinds: list[str]) -> tuple[list[list[str]], dict[int, int]]:
    """The folded words of each line; and the lines that end inside a word, with the line in which it goes on. A word cut at a
    line's end belongs to the line where it begins, with its hyphen left out."""
    found = [tokens(lower(line)) if k == "body" else [] for line, k in zip(lines, kinds, strict=True)]
    cut: dict[int, int] = {}
    running = [i for i, k in enumerate(kinds) if k == "body"]
    for i, j in zip(running, running[1:], strict=False):
        line = lines[i].rstrip()
        if line[-1:] not in MARKS or not BROKEN.search(line):
            continue
        after = lines[j].lstrip()
        if after[:1].isalpha() and found[i] and found[j]:
            *_, last = PIECE.finditer(line)
            first = PIECE.search(lines[j])
            same = last.group()[-1].isupper() == after[0].isupper() or (line[-1] in "-‐‑" and after[0].isupper())
            if same and last.end() == len(line) - 1 and not lines[j][: first.start()].strip():
                cut[i] = j
                found[i][-1] += found[j][0]
                found[j] = found[j][1:]
    return found, cut


def places(lines: list[str], cut: dict[int, int], i: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The words of a line as (word, parts), where a part is (line, begin, end)."""
    got = [(m.group(), [(i, m.start(), m.end())]) for m in PIECE.finditer(lines[i])]
    got = got[1:] if i in cut.values() else got
    if i in cut:
        m = PIECE.search(lines[cut[i]])
        got[-1] = (got[-1][0] + m.group(), [*got[-1][1], (cut[i], m.start(), m.end())])
    return got


def readings(w: str, v: str) -> list[tuple]:
    """The ways in which the word `v` may have been read as `w`, as the confusions used: up to two among letters, and every sign
    in a word with letters is one (but digits before the first)."""
    signs = sum(c in SIGNS for c in w)
    out, todo = [], [(0, 0, ())]
    while todo:
        i, j, used = todo.pop()
        while True:
            if len(used) < signs + 2:
                todo += [(i + len(seen), j + len(meant), (*used, (seen, meant))) for seen, meant in BY_FIRST.get(w[i : i + 1], ()) if w.startswith(seen, i) and v.startswith(meant, j)]
            if i == len(w) or j == len(v) or w[i] != v[j] or (w[i] in SIGNS and (used or w[i] not in "0123456789")):
                break
            i, j = i + 1, j + 1
        if used and i == len(w) and j == len(v) and len(used) - sum(seen in SIGNS for seen, _ in used) <= 2:
            out.append(used)
    return sorted(out, key=lambda u: (len(u), u))


def key_of(w: str) -> str:
    """What a word has in common with all words that may be read for it; empty for one without letters."""
    return w.translate(KEY) if any(c.isalpha() for c in w) else ""


def letters_of(words) -> Counter:
    """Letters of the words (w, n) that stand more than twice."""
    out: Counter = Counter()
    for w, n in words:
        for c in w if n > 2 else "":
            if c.isalpha():
                out[c] += min(n, 100)
    return out


def least_of(w: str, n: int) -> int:
    """How often a word must stand, to explain all of a misreading's."""
    return n * (RATIO_SIGNS if any(c in SIGNS for c in w) else RATIO_LETTERS)


def rates(read: Counter, stood: Counter) -> dict:
    """The rate of each confusion."""
    return {u: min(0.05, (read[u] + 1) / (stood[u[1]] + 1_000)) for u in CONFUSIONS}


class Model:
    """The channel and the language model.

    `info`: for each word how often it stands, the count of its own that is left to it, and its candidates (word, count, own
    count), as far as they are known here.
    """

    def __init__(self, info: dict[str, tuple[int, int, list[tuple[str, int, int]]]], pairs: dict[tuple[str, str], int], total: int, letters: Counter, rate: dict):
        self.info, self.pairs, self.total, self.rate = info, pairs, max(total, 1), rate
        every = sum(letters.values()) or 1
        self.letter = {c: log((n + 1) / (every + 60)) for c, n in letters.items()}
        self.rare = log(1 / (every + 60)) if every > 1_000 else log(1e-3)
        self.candidates = lru_cache(200_000)(self._candidates)

    def extended(self, words: list, pairs: list) -> Model:
        """The model with more words (b, n, own, options) and pairs (a, b, n), for one stretch."""
        if not words and not pairs:
            return self
        new = copy(self)
        new.info = ChainMap({w["b"]: (w["n"], w["own"], [(o["v"], o["n"], o["own"]) for o in w["options"] or ()]) for w in words}, self.info)
        new.pairs = ChainMap({(p["a"], p["b"]): p["n"] for p in pairs}, self.pairs)
        new.candidates = lru_cache(1_000)(new._candidates)
        return new

    def _channel(self, used: tuple) -> float:
        return sum(log(self.rate[u]) for u in used)

    def unknown(self, w: str) -> float:
        """Log probability of a word that the table doesn't hold."""
        return log(UNKNOWN) + sum(-7.0 if c in SIGNS else self.letter.get(c, self.rare) for c in w)

    def _candidates(self, w: str) -> list[tuple[str, float, float, tuple, int, int]]:
        """(word, log probability by itself, of the channel, confusions, count, own count) of what a folded word may be."""
        n, own, options = self.info.get(w, (0, 0, ()))
        out = [(w, log(own / self.total) if own >= 1 else self.unknown(w), 0.0, (), n, own)]
        for v, n, own in sorted(options):
            if own >= 2 and (ways := readings(w, v)):
                used = max(ways, key=self._channel)
                out.append((v, log(own / self.total), self._channel(used), used, n, own))
        return out

    def step(self, before: tuple | None, now: tuple) -> float:
        """Log probability of a word after another (none at the beginning of a line)."""
        pair = self.pairs.get((before[0], now[0]), 0) if before and now[5] else 0
        alone = LAMBDA * 2.718281828 ** max(now[1], -700)
        return log(max(alone + (1 - LAMBDA) * pair / before[4] if pair and before[4] else alone, 1e-300)) + now[2]

    def decode(self, line: list[str]) -> list[tuple[str, tuple]]:
        """The most probable words of a line, with the confusions of each."""
        layers, scores, before = [], [0.0], [None]
        for w in line:
            some, new, back = self.candidates(w), [], []
            for c in some:
                by = [s + self.step(b, c) for b, s in zip(before, scores, strict=True)]
                back.append(by.index(max(by)))
                new.append(by[back[-1]])
            layers.append((some, back))
            scores, before = new, some
        k, out = scores.index(max(scores)), []
        for some, back in reversed(layers):
            out.append((some[k][0], some[k][3]))
            k = back[k]
        return out[::-1]


def placed(word: str, used: tuple, meant: str) -> list[tuple[int, int, str]]:
    """The places of the confusions that turn the word into what was meant."""
    folded = lower(word)
    capital = sum(c.isupper() for c in word) > sum(c.islower() for c in word)
    todo = [(0, 0, 0, ())]  # places in the word and in what was meant, confusions used, and where
    while todo:
        i, j, k, at = todo.pop()
        while True:
            if k < len(used) and folded.startswith(used[k][0], i) and meant.startswith(used[k][1], j):
                todo.append((i + len(used[k][0]), j + len(used[k][1]), k + 1, (*at, (i, i + len(used[k][0]), used[k][1]))))
            if i == len(folded) or j == len(meant) or folded[i] != meant[j]:
                break
            i, j = i + 1, j + 1
        if (i, j, k) == (len(folded), len(meant), len(used)):
            return [(b, e, m.replace("i", "İ").upper() if capital else m) for b, e, m in at]
    return []


KIND = {"body": "b", "blank": " ", "page_no": "p", "header": "h", "cut": "c"}


def apart(text: str, other: str | None) -> tuple[str, str]:
    """A text taken apart: the kinds of its lines, a letter each, and their folded words."""
    lines, kinds, _ = page_parts(skeleton(text), other)
    found, cut = words(lines, kinds)
    return "".join(KIND["cut" if i in cut else k] for i, k in enumerate(kinds)), "\n".join(map(" ".join, found))


def repair(text: str, kinds: str, changes: list[tuple[int, int, str, tuple]]) -> tuple[str, list[tuple[str, int]]]:
    """The repaired text, and (kind, line) of everything that was found in it; from the kinds of its lines (`apart`) and the
    changes (line, number of the word, what was meant, confusions)."""
    lines, names = skeleton(text).split("\n"), {v: k for k, v in KIND.items()}
    body = [i for i, k in enumerate(kinds) if k in "bc"]
    cut = {i: j for i, j in zip(body, body[1:], strict=False) if kinds[i] == "c"}
    whole = ["body" if k == "c" else names[k] for k in kinds]
    marks = [(k, i) for i, k in enumerate(whole) if k in ("page_no", "header")] + [("hyphen", i) for i in cut]
    edits: dict[int, list[tuple[int, int, str]]] = {}
    at: dict[int, list] = {}
    for i, k, meant, used in changes:
        word, parts = at.setdefault(i, places(lines, cut, i) if i not in at else at[i])[k]
        for begin, end, new in placed(word, used, meant):
            passed = 0
            for where, a, b in parts:
                size = b - a
                if passed <= begin < passed + size:
                    edits.setdefault(where, []).append((a + begin - passed, min(b, a + end - passed), new))
                passed += size
    marks += [("misread", i) for i in sorted(edits)]
    for i, some in edits.items():
        for begin, end, new in sorted(some, reverse=True):
            lines[i] = lines[i][:begin] + new + lines[i][end:]
    return paragraphs(lines, whole, cut), sorted(marks, key=lambda m: (m[1], m[0]))


def paragraphs(lines: list[str], kinds: list[str], cut: dict[int, int]) -> str:
    """The running text: lines without page furniture, wrapped lines and cut words put together."""
    body = [i for i, k in enumerate(kinds) if k == "body"]
    sizes = sorted(len(lines[i].rstrip()) for i in body)
    width = sizes[int(len(sizes) * 0.9)] if sizes else 0
    out: list[str] = []
    glue = ""
    for n, i in enumerate(body):
        line = lines[i].strip()
        if n and glue is not None and out:
            out[-1] += glue + line
        else:
            out.append(line)
        if n + 1 == len(body):
            break
        after = lines[body[n + 1]].strip()
        gap = any(kinds[j] == "blank" and lines[j] == "" for j in range(i + 1, body[n + 1])) and not any(kinds[j] in ("page_no", "header") or "\f" in lines[j] for j in range(i + 1, body[n + 1]))
        if i in cut:
            whole = out[-1].rstrip()
            own = whole.endswith("-") and after[:1].isupper() != whole[-2:-1].isupper()
            out[-1], glue = (whole, "") if own else (whole[:-1], "")
        else:
            full = len(line) + 1 + len(after.split(" ")[0]) > width * 0.9
            continues = full and not line.endswith(":") and not re.match(r"[^\W\d_][\w .]{0,24}(?::| -$)", after) and not (gap and line.endswith("."))
            glue = " " if continues or after[:1].islower() else None
    return "\n".join(out)


def fields(ocr: DataFrame) -> DataFrame:
    """(ocr_id, field, text, other) of both readings of each page; null texts are left out."""
    a = ocr.select("ocr_id", F.lit("text").alias("field"), "text", F.col("alt_text").alias("other"))
    b = ocr.select("ocr_id", F.lit("alt_text").alias("field"), F.col("alt_text").alias("text"), F.col("text").alias("other"))
    return a.unionByName(b).filter("text is not null")


def counts(taken: DataFrame) -> DataFrame:
    """(a, b, n): how often the folded word b follows a in a line of running text; with a empty, how often it stands
    at all."""
    line = taken.select(F.explode(F.split("folded", "\n", -1)).alias("line")).filter("line <> ''").select(F.split("line", " ", -1).alias("w"))
    one = F.transform("w", lambda w: F.struct(F.lit("").alias("a"), w.alias("b")))
    two = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.struct(F.element_at("w", i - 1).alias("a"), F.element_at("w", i).alias("b")))
    every = F.when(F.size("w") > 1, F.concat(one, two)).otherwise(one)
    return line.select(F.explode(every).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def estimated(single: DataFrame) -> tuple[DataFrame, Counter, dict]:
    """Of the words (b, n): (b, n, own, options), the letters, and the rates. One round of expectation and maximisation: a word
    that is a possible misreading of one many times as frequent has no count of its own and is evidence for the confusions.
    `options` are the candidates (v, n, own) of a word, null where it has none. Words that may be one another meet by
    their key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key_of(w) for w in b.column(0).to_pylist()], pa.string())], names=["b", "n", "key"])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, wn, least_of(w, wn), v, n, [x for u in some[0] for x in u]) for w, wn, v, n in zip(*(c.to_pylist() for c in b.columns), strict=True) if (some := readings(w, v))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["w", "wn", "least", "v", "n", "used"])

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            got = [("letter", c, n) for c, n in letters_of(rows).items()] + [("stood", t, sum(n * w.count(t) for w, n in rows)) for t in sorted({t for _, t in CONFUSIONS})]
            columns = list(zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["what", "c", "n"])

    with_key = written(single.select("b", "n").mapInArrow(keyed, "b string, n long, key string"), "ocr-keys")
    single = with_key.select("b", "n")
    read_as = with_key.filter("key <> ''").toDF("w", "wn", "key")
    meant = with_key.filter("key <> '' and n >= 2 and length(b) > 1").toDF("v", "n", "key")
    both = read_as.join(meant.hint("merge"), "key").filter("w <> v").select("w", "wn", "v", "n")
    maybe = written(both.mapInArrow(ways, "w string, wn long, least long, v string, n long, used array<string>"), "ocr-ways")
    best = written(maybe.filter("n > least").groupBy("w", "wn").agg(F.max(F.struct("n", "v", "used")).alias("best")).select("w", "wn", "best.used"), "ocr-misread")
    own = written(single.join(best.select(F.col("w").alias("b"), F.lit(0).cast("long").alias("own")).hint("merge"), "b", "left").withColumn("own", F.coalesce("own", "n")), "ocr-own")
    read: Counter = Counter()
    for r in best.groupBy("used").agg(F.sum("wn").alias("n")).collect():
        for u in zip(r.used[::2], r.used[1::2], strict=True):
            read[u] += r.n
    sums = {"letter": Counter(), "stood": Counter()}
    for r in single.mapInArrow(letters, "what string, c string, n long").groupBy("what", "c").agg(F.sum("n").alias("n")).collect():
        sums[r.what][r.c] = r.n
    known = maybe.select("w", "v").join(own.filter("own >= 2").select(F.col("b").alias("v"), "n", "own").hint("merge"), "v")
    options = known.groupBy(F.col("w").alias("b")).agg(F.collect_list(F.struct("v", "n", "own")).alias("options"))
    return written(own.join(options.hint("merge"), "b", "left"), "ocr-info"), sums["letter"], rates(read, sums["stood"])


def unsure(info: DataFrame) -> bytes:
    """A filter of the words that have candidates: a bit for each word by its checksum. Its size is fixed; the more words have
    candidates, the less it keeps out."""
    cell = F.crc32(F.encode("b", "UTF-8")) % FILTER_BITS
    got = info.filter("options is not null").groupBy(F.shiftright(cell, 5).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 32).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, "<u4")
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint64).astype(np.uint32)
    return out.tobytes()


def stretches(taken: DataFrame, bits) -> DataFrame:
    """(row, line_no, at, stretch): the stretches of unsure words of each line; `at` is the number of the first word in it. A stretch
    is the words with a neighbour on both sides, where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = bits.value, {}

        def may(w: str) -> bool:
            if (k := told.get(w)) is None:
                if len(told) > 500_000:
                    told.clear()
                c = crc32(w.encode()) % FILTER_BITS
                k = told[w] = bool(held[c >> 3] >> (c & 7) & 1)
            return k

        for b in batches:
            rows = []
            for row, folded in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for no, line in enumerate(folded.split("\n")):
                    w = line.split(" ") if line else []
                    odd = [i for i, x in enumerate(w) if may(x)]
                    while odd:
                        n = next((n for n in range(1, len(odd)) if odd[n] != odd[n - 1] + 1), len(odd))
                        begin = max(0, odd[0] - 1)
                        # a blank before it: the stretch begins its line
                        rows.append((row, no, begin, ("" if begin else " ") + " ".join(w[begin : odd[n - 1] + 2])))
                        odd = odd[n:]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["row", "line_no", "at", "stretch"])

    return taken.select("row", "folded").mapInArrow(run, "row long, line_no int, at int, stretch string")


def words_of(stretch: str) -> list[str]:
    """The words of a stretch; that of the beginning of a line has none before them."""
    return stretch.strip(" ").split(" ")


def decoded(some: DataFrame, info: DataFrame, double: DataFrame, total: int, letters: Counter, rate: dict) -> DataFrame:
    """(stretch, changes) of the distinct stretches in which a word is changed; changes are (number of the word, what was meant,
    confusions).

    `info`: b, n, own, options; `double`: a, b, n. The most frequent of both are sent, the others looked up by joins.
    """
    short = lambda *c: reduce(lambda x, y: x & y, (F.length(x) <= SENT_CHARS for x in c))
    keep = chosen(info, "n", WORDS, "b") & short("b") & (F.coalesce(F.size("options"), F.lit(0)) <= SENT_OPTIONS)
    keep_pairs = chosen(double, "n", PAIRS, "a", "b") & short("a", "b")
    sent = {r.b: (r.n, r.own, [(o.v, o.n, o.own) for o in r.options or () if len(o.v) <= 2 * SENT_CHARS]) for r in info.filter(keep).collect()}
    held = some.sparkSession.sparkContext.broadcast((sent, {(r.a, r.b): r.n for r in double.filter(keep_pairs).collect()}, total, letters, rate))
    some = written(some.select("stretch").distinct(), "ocr-stretches")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(held, lambda x: Model(*x))
        for b in batches:
            rows = [(s, w) for s in b.column(0).to_pylist() for w in set(words_of(s)) if w not in model.info]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["stretch", "b"])

    def double_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(held, lambda x: Model(*x))
        for b in batches:
            rows = []
            for s, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m, line = model.extended(more or [], []), words_of(s)
                rows += [(s, *p) for p in {(x[0], y[0]) for p, q in zip(line, line[1:], strict=False) for x in m.candidates(p) for y in m.candidates(q)} if p not in m.pairs]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["stretch", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(held, lambda x: Model(*x))
        change = pa.struct([("k", pa.int32()), ("meant", pa.string()), ("used", pa.list_(pa.string()))])
        for b in batches:
            out = []
            for s, more, pairs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = [{"k": k, "meant": meant, "used": [x for u in used for x in u]} for k, (meant, used) in enumerate(model.extended(more or [], pairs or []).decode(words_of(s))) if used]
                if got:
                    out.append((s, got))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([g for _, g in out], pa.list_(change))], names=["stretch", "changes"])

    need = some.mapInArrow(single, "stretch string, b string").join(info.filter(~keep), "b")
    need = need.groupBy("stretch").agg(F.collect_list(F.struct("b", "n", "own", "options")).alias("more_words"))
    some = written(some.join(need, "stretch", "left"), "ocr-stretches")
    need = some.mapInArrow(double_of, "stretch string, a string, b string").join(double.filter(~keep_pairs), ["a", "b"])
    need = need.groupBy("stretch").agg(F.collect_list(F.struct("a", "b", "n")).alias("more_pairs"))
    return some.join(need, "stretch", "left").select("stretch", "more_words", "more_pairs").mapInArrow(run, "stretch string, changes array<struct<k:int,meant:string,used:array<string>>>")


def heading_of(other: str | None) -> tuple[str, str] | None:
    """The heading of another reading, from as many of its lines as it takes."""
    if not other:
        return None
    size = 8
    while True:
        lines = other.split("\n", size)
        whole = len(lines) <= size
        heading = page_parts(skeleton("\n".join(lines if whole else lines[:size])))[2]
        if whole or all(heading):
            return heading
        size *= 4


def corrections(taken: DataFrame) -> DataFrame:
    """(row, changes): the changes (line, number of the word, what was meant, confusions) of the texts that have any."""
    every = written(counts(taken), "ocr-counts")
    single, double = every.filter("a = ''").select("b", "n"), every.filter("a <> '' and n > 1")
    total = single.agg(F.sum("n").alias("n")).first().n or 0
    info, letters, rate = estimated(single)
    at = written(stretches(taken, taken.sparkSession.sparkContext.broadcast(unsure(info))), "ocr-unsure")
    got = at.join(decoded(at, info, double, total, letters, rate), "stretch").select("row", "line_no", "at", F.explode("changes").alias("c"))
    one = F.struct("line_no", (F.col("at") + F.col("c.k")).alias("k"), "c.meant", "c.used")
    return got.groupBy("row").agg(F.collect_list(one).alias("changes"))


def repaired(ocr: DataFrame) -> DataFrame:
    """Both readings of each page repaired: ocr_id, field, `repaired`, and `marks`, the (kind, line_no) of what was
    found, lines counted from 0.

    A null text gives no row, an empty one an empty text without marks; repeated rows stay repeated. A text of
    one endless line is handled as one line.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [apart(t, o) for t, o in zip(b.column("text").to_pylist(), b.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("ocr_id"), b.column("field"), b.column("text"), pa.array([k for k, _ in got], pa.string()), pa.array([f for _, f in got], pa.string())], names=["ocr_id", "field", "text", "kinds", "folded"])

    taken = spread(fields(ocr)).mapInArrow(take, "ocr_id long, field string, text string, kinds string, folded string")
    taken = written(taken.withColumn("row", F.monotonically_increasing_id()), "ocr-apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for text, kinds, changes in zip(*(b.column(c).to_pylist() for c in ("text", "kinds", "changes")), strict=True):
                some = [(c["line_no"], c["k"], c["meant"], tuple(zip(c["used"][::2], c["used"][1::2], strict=True))) for c in changes or ()]
                got.append(repair(text, kinds, some))
            marks = pa.array([[{"kind": k, "line_no": i} for k, i in m] for _, m in got], pa.list_(pa.struct([("kind", pa.string()), ("line_no", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("ocr_id"), b.column("field"), pa.array([t for t, _ in got], pa.string()), marks], names=["ocr_id", "field", "repaired", "marks"])

    every = taken.join(corrections(taken), "row", "left").select("ocr_id", "field", "text", "kinds", "changes")
    return every.mapInArrow(run, "ocr_id long, field string, repaired string, marks array<struct<kind:string,line_no:bigint>>")


def found(fixed: DataFrame) -> DataFrame:
    """(ocr_id, field, kind, line_no) of everything found."""
    return fixed.select("ocr_id", "field", F.explode("marks").alias("m")).select("ocr_id", "field", "m.kind", "m.line_no")
