"""Stages that ask a model: spans of entities, a judge of what is left, answers with retries.

A model is any callable that is made once for each worker process, by a factory that is sent there; nothing here knows a
vendor. Rows go through in batches; an error becomes a value of its row, with the error's type and never its message,
which may quote the text. The offline stand-ins at the end are deterministic.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tahlil.operators.classify import json_of
from tahlil.operators.gate import FINDINGS, is_label_only, is_medical_code, is_real, is_self_refuting

Span = tuple[int, int, str, float]  # start, end, label, score
SPANS = "array<struct<start:int,end:int,text:string,label:string,score:double>>"
ATTEMPTS = "array<struct<attempt:int,outcome:string>>"
RETRIED, FINAL = ("Timeout", "TimeoutError", "ConnectionError", "Overloaded"), ("done", "refused", "cut", "failed")


def extended(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of `df` with one more column, in place of one of that name."""
    fields = [f for f in df.schema.fields if f.name != name]
    return StructType([*fields, *StructType.fromDDL(f"{name} {kind}").fields])


def entities(df: DataFrame, text: str, make: Callable[[], Callable[[str], list[Span]]], least: float = 0.3, header_lines: int = 14, out: str = "spans") -> DataFrame:
    """`df` with the spans a model finds in each text, those of at least a score. A text mostly in capitals is read a
    second time in a form of the same length that has capitals only at the beginning of words, and the first lines are
    read once more by themselves; equal spans count once, with the higher score. Null and empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for f in frames:
            rows = []
            for t in f[text]:
                best: dict[tuple[int, int, str], float] = {}
                variants = [t, title_case(t)] if t and mostly_capitals(t) else [t] if t else []
                head = "\n".join((t or "").split("\n")[:header_lines])
                for v in [*variants, *([head] if head and head != t else [])]:
                    for a, b, label, score in predict(v):
                        if score >= least:
                            best[a, b, label] = max(score, best.get((a, b, label), 0.0))
                rows.append([{"start": a, "end": b, "text": t[a:b], "label": label, "score": s} for (a, b, label), s in sorted(best.items())])
            yield f.drop(columns=out, errors="ignore").assign(**{out: rows})

    return df.drop(out).mapInPandas(run, extended(df, out, SPANS))


def mostly_capitals(text: str) -> bool:
    """Whether more than half of the letters are capitals."""
    return sum(c.isupper() for c in text) * 2 > sum(c.isalpha() for c in text)


def title_case(text: str) -> str:
    """Capitals only at the beginning of words, in Turkish; every character stays one character."""
    small = lambda c: "i" if c == "İ" else "ı" if c == "I" else c.lower() if len(c.lower()) == 1 else c
    return re.sub(r"[^\W\d_]+", lambda m: m.group()[0] + "".join(map(small, m.group()[1:])), text)


CORRECTION = 'Yanıt {"findings": [...]} biçiminde geçerli JSON değildi; yalnızca kısa ve geçerli JSON ver. Önceki yanıtın başı: '  # asked again with


def judged(df: DataFrame, text: str, make: Callable[[], Callable[[str], str]], attempts: int = 2, out: str = "judge") -> DataFrame:
    """`df` with what a judge finds in each text: (findings, error). The answer must be JSON with a list `findings`; else
    it is asked again, told what was wrong and how its answer began, and then the row has an error. Findings that don't stand in the text, are labels only, refute
    themselves, or are medical codes are dropped."""

    def ask(chat: Callable[[str], str], t: str | None) -> tuple[list[dict], str | None]:
        error, prompt = None, t
        for _ in range(attempts if t else 0):
            said = ""
            try:
                said = chat(prompt)
                found = json.loads(re.search(r"\{.*\}", said, re.DOTALL).group())["findings"]
                if isinstance(found, list):
                    keys = ("text", "type", "reason")
                    return [{k: str(x.get(k, "")) for k in keys} | {"source": "llm_judge"} for x in found if isinstance(x, dict)], None
                error = "NotAList"
            except Exception as e:  # noqa: BLE001
                error = type(e).__name__
            prompt = f"{t}\n\n{CORRECTION}{str(said)[:500]}"
        return [], error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make()
        for f in frames:
            got = [ask(chat, t) for t in f[text]]
            yield f.drop(columns=out, errors="ignore").assign(**{out: [{"findings": x, "error": e} for x, e in got]})

    asked = df.drop(out).mapInPandas(run, extended(df, out, f"struct<findings:{FINDINGS},error:string>"))
    keep = lambda x: is_real(x["text"], F.col(text)) & ~is_label_only(x["text"]) & ~is_self_refuting(x["text"], x["reason"]) & ~is_medical_code(x["text"], x["type"])
    return asked.withColumn(out, F.struct(F.filter(F.col(out)["findings"], keep).alias("findings"), F.col(out)["error"].alias("error")))


def answered(df: DataFrame, text: str, make: Callable[[], Callable[[str], dict]], attempts: int = 3, wait: float = 0.5, allow: Callable[[str], bool] | None = None) -> DataFrame:
    """`df` with a model's answer to each text that may go out (`allowed`): `answer`, its `json`, the `outcome` (done,
    refused, cut, failed, blocked) and all `attempts`, so that each can be audited. Only passing errors are tried again.
    Between attempts it waits, twice as long each time (`wait` seconds at first). Before each attempt `allow`, if there is one, is
    asked anew whether this text may go out; if not, the attempt is logged as blocked and nothing is sent.
    The text goes out only if `allowed` is true; the model returns {"stop_reason": ..., "text": ...}."""

    def ask(complete: Callable[[str], dict], t: str) -> tuple[str | None, str, list[dict]]:
        log: list[dict] = []
        for n in range(1, attempts + 1):
            if n > 1:
                time.sleep(wait * 2 ** (n - 2))
            if allow is not None and not allow(t):
                log.append({"attempt": n, "outcome": "blocked"})
                return None, "blocked", log
            try:
                r = complete(t)
                outcome = {"refusal": "refused", "max_tokens": "cut"}.get(r.get("stop_reason"), "done")
                log.append({"attempt": n, "outcome": outcome})
                return (r.get("text") if outcome == "done" else None), outcome, log
            except Exception as e:  # noqa: BLE001
                log.append({"attempt": n, "outcome": type(e).__name__})
                if type(e).__name__ not in RETRIED:
                    break
        return None, "failed", log

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make()
        for f in frames:
            got = [ask(complete, t) if ok is True or ok == 1 and ok is not None else (None, "blocked", []) for t, ok in zip(f[text], f["allowed"], strict=True)]
            yield f.assign(answer=[g[0] for g in got], outcome=[g[1] for g in got], attempts=[g[2] for g in got])

    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"answer string, outcome string, attempts {ATTEMPTS}").fields])
    return df.mapInPandas(run, schema).withColumn("json", json_of(F.col("answer")))


def inlined(schema: dict) -> dict:
    """A JSON schema with every reference replaced by what it names."""
    named = schema.get("$defs", {}) | schema.get("definitions", {})

    def walk(x):
        if isinstance(x, dict):
            if "$ref" in x:
                return walk({k: v for k, v in x.items() if k != "$ref"} | named[x["$ref"].rsplit("/", 1)[1]])
            return {k: walk(v) for k, v in x.items() if k not in ("$defs", "definitions")}
        return [walk(v) for v in x] if isinstance(x, list) else x

    return walk(schema)


def offline_entities() -> Callable[[str], list[Span]]:
    """A stand-in that finds numbers of eleven digits and pairs of words that begin with capitals after a label."""

    def predict(text: str) -> list[Span]:
        out = [(m.start(), m.end(), "national id", 0.9) for m in re.finditer(r"(?<!\d)[1-9]\d{10}(?!\d)", text)]
        return out + [(m.start(1), m.end(1), "person", 0.8) for m in re.finditer(r"(?:Hasta|Dr)\W+([A-ZÇĞİÖŞÜ][^\W\d_]+ [A-ZÇĞİÖŞÜ][^\W\d_]+)", text)]

    return predict


def offline_judge() -> Callable[[str], str]:
    """A stand-in that reports every number of eleven digits."""
    return lambda text: json.dumps({"findings": [{"text": m, "type": "id", "reason": "numara"} for m in re.findall(r"(?<!\d)\d{11}(?!\d)", text)]})
