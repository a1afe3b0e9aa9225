"""Problem 3: oversized texts in pieces under a size limit, cut at natural boundaries, with overlap.

A cut is chosen in the second half of the space that is left for a piece: among all natural boundaries there (of pages,
paragraphs, lines and sentences) the one at the deepest valley of lexical cohesion, that is where the words of the
block before it and of the block after it have least in common, compared with the boundaries on both sides. Of equally deep
ones the better kind of boundary wins, then the later. Only where there is none of them words are cut apart, by
the same measure. Without a boundary in that half, the half of what is left before it is searched, and so on;
only where the whole window has none the text is cut at the limit. Every piece but the first
starts `overlap` characters before the cut at which the one before it ended.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tahlil.functions.turkish import plain

LIMIT, OVERLAP = 2_000, 200
BLOCK_WORDS = 40  # words of a block whose cohesion is compared
KINDS = ("page", "paragraph", "line", "sentence", "word", "none")
BOUNDARIES = (re.compile(r"\f\n?"), re.compile(r"\n[ \t]*\n\s*"), re.compile(r"\n"), re.compile(r"[.!?:;]+[\"')\]]*\s+"), re.compile(r"\s+"))
WORD = re.compile(r"[^\W_]{3,}")
PIECES = "tbl string, rec_key string, piece_no int, begin_at int, end_at int, cut string, piece string"


def similarity(a: Counter, b: Counter) -> float:
    """Cosine of two bags of words."""
    norm = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    return sum(v * b[k] for k, v in a.items()) / norm**0.5 if norm else 0.0


def valley(text: str, gaps: dict[int, int], lo: int, hi: int) -> int:
    """Of the gaps (place and kind, the best 0), the one with the deepest valley of cohesion in text[lo:hi]; of equals the
    better kind, then the last."""
    margin = BLOCK_WORDS * 12
    lo, hi = max(0, lo - margin), min(len(text), hi + margin)
    found = [(m.start(), m.group()) for m in WORD.finditer(plain(text[lo:hi]))]
    places, scores, k = sorted(gaps), [], 0
    for g in places:
        while k < len(found) and found[k][0] < g - lo:
            k += 1
        scores.append(similarity(Counter(w for _, w in found[max(0, k - BLOCK_WORDS) : k]), Counter(w for _, w in found[k : k + BLOCK_WORDS])))
    left = list(accumulate(scores, max))
    right = list(accumulate(reversed(scores), max))[::-1]
    depth = [a + b - 2 * s for a, b, s in zip(left, right, scores, strict=True)]
    return places[max(range(len(places)), key=lambda i: (round(depth[i], 9), -gaps[places[i]], i))]


def boundaries(text: str, begin: int, lo: int, hi: int) -> dict[int, int]:
    """The natural boundaries in text[lo:hi] and the kind of each (a place in KINDS): all but those of words; those only where
    there are no others."""
    gaps: dict[int, int] = {}
    for kind, pattern in enumerate(BOUNDARIES):
        if KINDS[kind] == "word" and gaps:
            break
        for m in pattern.finditer(text, max(begin, lo - 200), hi):
            if lo <= m.end() <= hi:
                gaps.setdefault(m.end(), kind)
    return gaps


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(begin, end, kind of the cut at the end) of each piece; text[begin:end] is the piece.

    The last cut is the end of the text, of kind `none`. An empty text is one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    out, begin, cut = [], 0, 0
    while len(text) - begin > limit:
        hi = begin + limit
        least, top = max(cut + 1, begin + overlap + 1), hi
        lo = max(least, cut + (hi - cut) // 2)
        while not (gaps := boundaries(text, begin, lo, top)) and lo > least:
            lo, top = max(least, cut + (lo - cut) // 2), lo - 1
        end = valley(text, gaps, lo, top) if gaps else hi
        out.append((begin, end, KINDS[gaps[end]] if gaps else "none"))
        begin, cut = end - overlap, end
    return [*out, (begin, len(text), "none")]


def split(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(tbl, rec_key, text) to its pieces: `piece_no` from 0, `begin_at` and `end_at` in the text, the kind of
    the `cut` at the end, and the `piece` itself.

    A text within the limit, also an empty one, is one piece and never leaves the JVM; a null text has none.
    Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(tbl, key, i, begin, end, kind, text[begin:end]) for tbl, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, (begin, end, kind) in enumerate(pieces(text, limit, overlap))]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tbl", "rec_key", "piece_no", "begin_at", "end_at", "cut", "piece"])

    size = F.length("text")
    short = texts.filter(size <= limit).select("tbl", "rec_key", F.lit(0).alias("piece_no"), F.lit(0).alias("begin_at"), size.alias("end_at"), F.lit("none").alias("cut"), F.col("text").alias("piece"))
    long = texts.filter(size > limit).select("tbl", "rec_key", "text").mapInArrow(run, PIECES)
    return short.unionByName(long)


def oversized(cut: DataFrame) -> DataFrame:
    """(tbl, rec_key) of the texts that had to be cut: those with a second piece."""
    return cut.filter("piece_no = 1").select("tbl", "rec_key")


def joined(cut: DataFrame) -> DataFrame:
    """(tbl, rec_key, text): the texts put together again from their pieces, without the overlaps. (tbl, rec_key) must be unique."""
    parts = cut.groupBy("tbl", "rec_key").agg(F.sort_array(F.collect_list(F.struct("piece_no", "begin_at", "end_at", "piece"))).alias("p"))
    own = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substr(x["piece"], F.get("p", i - 1)["end_at"] - x["begin_at"] + 1)))
    return parts.select("tbl", "rec_key", F.array_join(own, "").alias("text"))


def texts(ocr: DataFrame, ner: DataFrame) -> DataFrame:
    """(tbl, rec_key, text) of both tables."""
    a = ocr.select(F.lit("ocr_result").alias("tbl"), F.col("ocr_id").cast("string").alias("rec_key"), "text")
    b = ner.select(F.lit("ner_result").alias("tbl"), F.col("ner_id").cast("string").alias("rec_key"), "text")
    return a.unionByName(b)
