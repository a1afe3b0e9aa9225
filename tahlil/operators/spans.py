"""Spans of text: their order, union of overlaps, masking by place, and text in chunks.

A span is (start, end, text, label, score), places half open from 0. Spans of one text are an array column, so no
operator here needs an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and their mask tags (fixed values).
TAGS = {"person": "[KISI_SILINDI]", "national id": "[TC_SILINDI]", "phone number": "[TEL_SILINDI]", "address": "[ADRES_SILINDI]", "email": "[EPOSTA_SILINDI]"}
OTHER_TAG = "[PII_SILINDI]"
CHUNK_WORDS = 250


def ordered(spans: Column) -> Column:
    """By start, then the longest first, then the highest score."""
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-s["score"]).alias("c"), s.alias("s")))
    return F.transform(F.array_sort(key), lambda k: k["s"])


def merged(spans: Column) -> Column:
    """Overlapping spans as one: it goes from the first start to the last end and has the label and score of the
    longest part, the higher score among equals. Spans that only touch stay apart; an empty array stays empty.

    A fold over the ordered spans; each is held against the merge so far.
    """
    part = "struct<start:int,end:int,label:string,score:double,len:int>"
    first = F.array().cast(f"array<{part}>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        size = s["end"] - s["start"]
        overlap = (F.size(acc) > 0) & (s["start"] < last["end"])
        better = (size > last["len"]) | ((size == last["len"]) & (s["score"] > last["score"]))
        fused = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            F.when(better, s["label"]).otherwise(last["label"]).alias("label"),
            F.when(better, s["score"]).otherwise(last["score"]).alias("score"),
            F.when(better, size).otherwise(last["len"]).alias("len"),
        ).cast(part)
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["score"].alias("score"), size.alias("len")).cast(part)
        return F.when(overlap, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(fused))).otherwise(F.concat(acc, F.array(fresh)))

    folded = F.aggregate(ordered(spans), first, step)
    return F.transform(folded, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["score"].alias("score")))


def tag_of(label: Column) -> Column:
    """The mask tag of a label."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv))[label], F.lit(OTHER_TAG))


def overlaid(text: Column, spans: Column) -> Column:
    """The text with each span's tag in its place; spans must not overlap. Applied from right to left, so that places
    stay right. Null text or spans give the text."""
    done = F.aggregate(F.reverse(ordered(spans)), text, lambda acc, s: F.overlay(acc, tag_of(s["label"]), s["start"] + 1, s["end"] - s["start"]))
    return F.coalesce(done, text)


def numbered(items: Column, begin: int = 1) -> Column:
    """Each item with its ordinal."""
    return F.transform(items, lambda x, i: F.struct((i + begin).alias("n"), x.alias("item")))


def chunks(df: DataFrame, key: str, text: str, budget: int = CHUNK_WORDS) -> DataFrame:
    """(key, chunk_no, offset, chunk): the text in runs of lines of at most `budget` words, a line of more words cut at
    blanks; offsets count characters. The running sum starts again at each chunk, so it is a fold, not a window."""

    def cut(x: str) -> list[tuple[int, str]]:
        pieces, at = [], 0
        for line in x.splitlines(keepends=True):
            words, begin = line.split(" "), 0
            for i in range(0, len(words), budget):
                part = " ".join(words[i : i + budget]) + (" " if i + budget < len(words) else "")
                pieces.append((at + begin, part, len(words[i : i + budget])))
                begin += len(part)
            at += len(line)
        out, size = [], 0
        for offset, part, n in pieces:
            if out and size + n <= budget:
                out[-1] = (out[-1][0], out[-1][1] + part)
                size += n
            else:
                out.append((offset, part))
                size = n
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, offset, part) for k, x in zip(f[key], f[text], strict=True) if x for i, (offset, part) in enumerate(cut(x))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "offset", "chunk"]).astype({"chunk_no": "int32", "offset": "int32"})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, chunk_no int, offset int, chunk string")
