"""Reports of models: what still identifies a person in them, when to look at them again, and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tahlil.operators.gate import final_rule, remaining

LEFT = "[RAPOR_KALINTI_SILINDI]"
TEXTS = ("gerekce", "yas_araligi", "cinsiyet", "histolojik_tip", "primer_bolge", "evre_tnm", "derece", "cerrahi_sinir", "lenf_nodu", "ozet")
LISTS = ("tedavi_ve_plan", "onerilen_ek_tetkik", "belirsizlikler")
STRUCTS = {"belirtecler": ("ad", "deger", "kanit"), "onemli_bulgular": ("madde", "kanit")}


def bad(leaf: Column, candidates: Column) -> Column:
    """Whether a text names a candidate or breaks a final rule; a null text does not."""
    return F.coalesce((F.size(remaining(candidates, leaf)) > 0) | final_rule(leaf).isNotNull(), F.lit(False))


def place_of(name: str, candidates: Column, field: str | None = None):
    """The path of an item of a list, if it is bad."""
    return lambda v, i: F.when(bad(v[field] if field else v, candidates), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{field}" if field else "]")))


def struct_of(fields: tuple[str, ...], candidates: Column):
    """An item of a list with its bad texts replaced."""
    return lambda v: F.struct(*(F.when(bad(v[f], candidates), F.lit(LEFT)).otherwise(v[f]).alias(f) for f in fields))


def redacted(candidates: Column) -> dict[str, Column]:
    """The columns of a report with each bad text replaced, and `redacted_paths`: where that was."""
    out: dict[str, Column] = {}
    paths = []
    for c in TEXTS:
        hit = bad(F.col(c), candidates)
        out[c] = F.when(hit, F.lit(LEFT)).otherwise(F.col(c))
        paths.append(F.when(hit, F.array(F.lit(c))).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    for c in LISTS:
        out[c] = F.transform(c, lambda v: F.when(bad(v, candidates), F.lit(LEFT)).otherwise(v))
        paths.append(F.coalesce(F.array_compact(F.transform(c, place_of(c, candidates))), none))
    for c, fields in STRUCTS.items():
        out[c] = F.transform(c, struct_of(fields, candidates))
        at = [F.transform(c, place_of(c, candidates, f)) for f in fields]
        paths += [F.coalesce(F.array_compact(x), none) for x in at]
    return out | {"redacted_paths": F.concat(*paths)}


def review_reasons(legibility: Column, malignancy: Column, confidence: Column, adjusted: Column, human: Column, was_redacted: Column, below: float = 0.4) -> Column:
    """Why a report should be looked at again."""
    return F.array_compact(
        F.array(
            F.when(was_redacted, F.lit("rapor çıktısında kalıntı maskelendi")),
            F.when(legibility == "kotu", F.lit("okunabilirlik: kötü")),
            F.when(malignancy == "belirsiz", F.lit("malignite belirsiz")),
            F.when(F.least(F.coalesce(confidence, F.lit(0.0)), F.coalesce(adjusted, F.lit(0.0))) < below, F.lit("düşük güven")),
            F.when(human, F.lit("doğrulama uyarısı")),
        )
    )


def bullets(title: str, items: Column) -> Column:
    """A section with one point for each item; null if there are none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"**{title}**\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("")))), "\n")))


def markdown() -> Column:
    """The text form of a report; sections without content are left out."""
    facts = (("Histolojik tip", "histolojik_tip"), ("Primer bölge", "primer_bolge"), ("Evre (TNM)", "evre_tnm"), ("Derece", "derece"), ("Cerrahi sınır", "cerrahi_sinir"), ("Lenf nodu", "lenf_nodu"), ("Yaş aralığı", "yas_araligi"), ("Cinsiyet", "cinsiyet"))
    head = F.concat(F.lit("**Otomatik özet** — kategori **"), F.coalesce("kategori", F.lit("Other")), F.lit("** · malignite: "), F.coalesce("malignite_durumu", F.lit("-")), F.lit(" · okunabilirlik: "), F.coalesce("okunabilirlik", F.lit("-")))
    list_ = F.array_compact(F.array(*(F.when(F.col(c) != "", F.concat(F.lit(f"- **{n}:** "), F.col(c))) for n, c in facts)))
    fact = F.when(F.size(list_) > 0, F.array_join(list_, "\n"))
    rows = F.transform("belirtecler", lambda m: F.concat(F.lit("| "), F.coalesce(m["ad"], F.lit("")), F.lit(" | "), F.coalesce(m["deger"], F.lit("")), F.lit(" |")))
    marks = F.when(F.size("belirtecler") > 0, F.concat(F.lit("**Belirteçler**\n\n| Belirteç | Sonuç |\n|---|---|\n"), F.array_join(rows, "\n")))
    summary = F.concat(F.lit("**Özet:** "), F.coalesce("ozet", F.lit("")), F.lit("\n\n*Gerekçe:* "), F.coalesce("gerekce", F.lit("")))
    return F.concat_ws("\n\n", head, fact, marks, bullets("Önemli bulgular", F.transform("onemli_bulgular", lambda b: b["madde"])), bullets("Tedavi / plan", F.col("tedavi_ve_plan")), bullets("Önerilen ek tetkik", F.col("onerilen_ek_tetkik")), summary, bullets("Belirsizlikler", F.col("belirsizlikler")))
