"""Categories of reports: reading a model's answer, keyword evidence, and the confidence that is left.

The keyword evidence is an expression over a literal dictionary, so classifying needs no join and no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tahlil.functions.let import let
from tahlil.functions.patterns import LETTERS
from tahlil.functions.turkish import fold

# The closed list of categories (fixed values).
CATEGORIES = tuple(
    """Adrenal_Gland Bile_Duct Bladder Blood Bone Bone_Marrow Brain Breast Cancer_all Cervix Colorectal Esophagus Eye Head_and_Neck
    Inflammatory Intrahepatic Kidney Liver Lung Lymph_Nodes Nervous_System Other Ovary Pancreas Pleura Prostate Skin Soft_Tissue
    Stomach Testis Thymus Thyroid Uterus""".split()
)
# Words of organs and the category of each.
ORGANS = {
    "kemik iliği": "Bone_Marrow", "yumuşak doku": "Soft_Tissue", "yemek borusu": "Esophagus", "böbrek üstü": "Adrenal_Gland", "safra yolu": "Bile_Duct",
    "lenf düğümü": "Lymph_Nodes", "yumurtalık": "Ovary", "endometrium": "Uterus", "miyometrium": "Uterus", "özofagus": "Esophagus", "karaciğer": "Liver",
    "akciğer": "Lung", "pankreas": "Pancreas", "prostat": "Prostate", "larinks": "Head_and_Neck", "parotis": "Head_and_Neck", "serviks": "Cervix",
    "rektum": "Colorectal", "mesane": "Bladder", "böbrek": "Kidney", "testis": "Testis", "tiroid": "Thyroid", "plevra": "Pleura", "beyin": "Brain",
    "kolon": "Colorectal", "çekum": "Colorectal", "timus": "Thymus", "kemik": "Bone", "rahim": "Uterus", "meme": "Breast", "mide": "Stomach",
    "deri": "Skin", "cilt": "Skin", "over": "Ovary", "lenf": "Lymph_Nodes", "göz": "Eye",
}
# Keywords of categories, in order of precedence among equals.
KEYWORDS = {
    "Lung": ("akciğer", "bronş", "plevral"), "Brain": ("beyin", "glioblastom", "meningiom"), "Breast": ("meme", "duktal karsinom", "lobüler karsinom"),
    "Liver": ("karaciğer", "hepatoselüler"), "Kidney": ("böbrek", "berrak hücreli", "onkositom"), "Bladder": ("mesane", "ürotelyal"),
    "Prostate": ("prostat", "asiner adenokarsinom"), "Thyroid": ("tiroid", "foliküler adenom", "medüller karsinom", "papiller karsinom"),
    "Skin": ("deri", "malign melanom", "bazal hücreli"), "Lymph_Nodes": ("lenf düğümü", "foliküler lenfoma", "büyük b hücreli lenfoma"),
    "Soft_Tissue": ("yumuşak doku", "liposarkom", "sinovyal sarkom"), "Stomach": ("mide", "taşlı yüzük", "stromal tümör"), "Pancreas": ("pankreas",),
    "Colorectal": ("kolon", "rektum", "çekum", "müsinöz adenokarsinom"), "Ovary": ("over", "endometrioid", "seröz karsinom"),
    "Uterus": ("endometrium", "miyometrium", "leiomyom"), "Esophagus": ("özofagus", "skuamöz hücreli"), "Testis": ("testis", "seminom"),
    "Head_and_Neck": ("larinks", "parotis", "pleomorfik adenom"), "Pleura": ("plevra",),
}
# Evidence for no category of its own (fixed values).
GENERIC = ("er", "pr", "ki67", "ki-67", "p53", "lenf nodu", "lenf", "adenokarsinom", "karsinom", "metastaz", "tümör", "malign", "grade", "evre", "biyopsi", "her2")
BENIGN = ("benign", "iyi huylu", "selim", "reaktif değişiklik", "malignite saptanmadı", "malignite izlenmedi", "displazi saptanmadı")
MALIGN = ("malign", "kötü huylu", "karsinom", "sarkom", "lenfoma", "lösemi", "seminom", "melanom", "blastom", "mezotelyoma", "nöroendokrin tümör")
NEGATED = "malign[a-zçğıöşü]*[ \\t]+(?:açısından|yönünden|bulgusu)?[ \\t]*(?:negatif|saptanmadı|izlenmedi|görülmedi|yok)"
PENALTY_CONFLICT, PENALTY_SHORT, SHORT = 0.7, 0.5, 50
SHORT_WARNING, HUMAN_WARNING = "Rapor metni çok kısa", "İnsan incelemesi önerilir"


def json_of(answer: Column) -> Column:
    """The JSON text in a model's answer: without its thoughts, in a fence, or between the outermost braces; null if
    there is none."""
    spoken = F.regexp_replace(answer, "(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(spoken, "(?s)```(?:json)?[ \\t\\n]*(\\{.*?\\})[ \\t\\n]*```", 1)
    braces = F.regexp_extract(spoken, "(?s)(\\{.*\\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces)


def clamped(x: Column) -> Column:
    """A confidence between 0 and 1; what is no number is 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.try_cast("double"))), F.lit(0.0))


def category(raw: Column) -> Column:
    """The category a free entry means: letter for letter, else in any case and separators, else as a whole word in it,
    else by the longest organ word in it, else Other."""
    names = F.array(*map(F.lit, CATEGORIES))
    organs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted(ORGANS.items(), key=lambda o: (-len(o[0]), o[0]))))
    first = lambda a: F.try_element_at(a, F.lit(1))

    def normalised(low: Column) -> Column:
        same = F.filter(names, lambda c: F.lower(c) == low)
        inside = F.filter(names, lambda c: F.concat(F.lit("_"), low, F.lit("_")).contains(F.concat(F.lit("_"), F.lower(c), F.lit("_"))))
        return F.coalesce(first(same), F.when(low != "", first(inside)))

    exact = F.when(F.array_contains(names, F.trim(raw)), F.trim(raw))
    organ = let(fold(raw), lambda x: first(F.filter(organs, lambda o: x.contains(o["k"])))["v"])
    return F.coalesce(exact, let(F.translate(F.lower(F.trim(raw)), " -", "__"), normalised), organ, F.lit("Other"))


def padded(text: Column) -> Column:
    """The folded text with single blanks between its words, and one at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(fold(text), f"[^{LETTERS}0-9]+", " "), F.lit(" "))


def evidence(text: Column) -> Column:
    """Categories with keywords in the text, in order of precedence: name, the keywords found, and how many."""
    rows = F.array(*(F.struct(F.lit(c).alias("category"), F.array(*(F.lit(k) for k in ks if k not in GENERIC)).alias("keywords")) for c, ks in KEYWORDS.items()))

    def met(t: Column) -> Column:
        some = F.transform(rows, lambda r: F.struct(r["category"].alias("category"), F.filter(r["keywords"], lambda k: t.contains(F.concat(F.lit(" "), k, F.lit(" ")))).alias("keywords")))
        return F.filter(F.transform(some, lambda r: F.struct(r["category"].alias("category"), r["keywords"].alias("keywords"), F.size(r["keywords"]).alias("score"))), lambda r: r["score"] > 0)

    return let(padded(text), met)


def best(found: Column) -> Column:
    """The entry of the highest score, the first among equals; null if there is none."""
    first = F.try_element_at(found, F.lit(1))
    return F.aggregate(found, first, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


def contradictions(text: Column, cat: Column, site: Column) -> Column:
    """Warnings about a text that contradicts its category: a metastasis given as the primary site; benign findings
    only, with a category of cancer."""
    any_of = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: x.contains(w))

    def warnings(t: Column) -> Column:
        meta = any_of(t, ("metastaz", "metastatik", "sekonder", "yayılım")) & fold(site).contains("metastaz")
        benign = any_of(t, BENIGN) & ~let(F.regexp_replace(t, NEGATED, ""), lambda x: any_of(x, MALIGN)) & (cat != "Other")
        return F.array_compact(F.array(F.when(meta, F.lit("Primer tümör yeri metastaz bölgesi olabilir")), F.when(benign, F.lit("Benign bulgular, kanser kategorisi"))))

    return let(fold(text), warnings)


def validated(cat: Column, confidence: Column, text: Column, site: Column, threshold: float = 0.6, review_below: float = 0.4) -> Column:
    """What is left of a classification: is_valid, best_category, keyword_matches, warnings, confidence_adjusted.

    A conflict lowers the confidence only if the best score is above the number of matches reported; where the chosen
    category has none, the best one's are reported, so nothing is lowered. Thresholds are checked before the penalty
    for a short text, whose warning comes last. The category never changes.
    """
    none = F.array().cast("array<string>")
    short = F.length(F.regexp_replace(text, "^[ \\t\\n]+|[ \\t\\n]+$", "")) < SHORT

    def weighed(x: Column) -> Column:
        top, own = x["top"], x["own"]
        matches = F.coalesce(F.when(F.size(own) > 0, F.element_at(own, 1)["keywords"]), top["keywords"], none)
        conflict = F.coalesce((top["category"] != cat) & (top["score"] > F.size(matches)), F.lit(False))
        return F.struct(top["category"].alias("best"), matches.alias("matches"), conflict.alias("conflict"), (confidence * F.when(conflict, PENALTY_CONFLICT).otherwise(1.0)).alias("middle"))

    def judged(x: Column) -> Column:
        first = F.array_compact(F.array(F.when(x["conflict"], F.concat(F.lit("Anahtar kelimeler: "), x["best"])), F.when(x["middle"] < threshold, F.lit("Güven skoru düşük")), F.when(x["middle"] < review_below, F.lit(HUMAN_WARNING))))
        every = F.concat(first, contradictions(text, cat, site), F.array_compact(F.array(F.when(short, F.lit(SHORT_WARNING)))))
        final = F.bround(x["middle"] * F.when(short, PENALTY_SHORT).otherwise(1.0), 3)
        return let(every, lambda w: F.struct((F.size(F.filter(w, lambda v: ~v.contains("İnsan incelemesi"))) == 0).alias("is_valid"), x["best"].alias("best_category"), x["matches"].alias("keyword_matches"), w.alias("warnings"), final.alias("confidence_adjusted")))

    of = lambda found: F.struct(best(found).alias("top"), F.filter(found, lambda r: r["category"] == cat).alias("own"))
    return let(let(let(evidence(text), of), weighed), judged)
