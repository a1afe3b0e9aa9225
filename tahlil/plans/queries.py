"""Queries of the core operators; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tahlil.functions import turkish
from tahlil.operators import classify, engine, gate, hybrid, jobs, metrics, models, names, quantities, report, rules, spans
from tahlil.plans import pipeline
from tahlil.session import scratch, spread, table
from tahlil.sources import files, sinks
from tahlil.streaming import jobs as stream

LAYERS = {"a01": "a01_national_id", "a02": "a02_reference_no", "a03": "a03_labelled", "a04": "a04_titles", "a05": "a05_dates", "a06": "a06_age_bucket", "a07": "a07_institution", "a08": "a08_contact", "a09": "a09_diploma", "a10": "a10_boilerplate", "a12": "a12_numeric_ids", "a13": "a13_cleanup", "a20": "a20_strict"}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_result").select("ocr_id", "text")


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


def _layer(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_texts(spark, sf_dir)).select("ocr_id", rules.layer(name, F.col("text")).alias("masked"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked forms with the spans found before masking, and their texts as candidates."""
    return table(spark, sf_dir, "ner_result").select("ner_id", "text", "spans", F.transform("spans", lambda s: s["text"]).alias("candidates"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked forms with the places where a mask tag stands in them as spans, and around each a wider one that overlaps it: (ner_id,
    raw, spans). The spans of the table point into the text before masking, which is not stored."""
    n = table(spark, sf_dir, "ner_result").filter("text is not null")
    pieces = F.split("text", "\\[", -1)
    at = F.transform(pieces, lambda p, i: F.length(p) + 1)  # a piece with the bracket before the next
    starts = F.filter(F.transform(F.sequence(F.lit(1), F.size("at")), lambda i: F.struct((F.aggregate(F.slice("at", F.lit(1), i), F.lit(0), lambda x, y: x + y) - 1).cast("int").alias("s"), F.get("pieces", i).alias("p"))), lambda x: F.coalesce(x["p"].contains("_SILINDI]"), F.lit(False)))
    span = lambda x, lead, tail, label, score: F.struct(F.greatest(F.lit(0), x["s"] - lead).cast("int").alias("start"), F.least(F.length("text"), x["s"] + F.instr(x["p"], "]") + 1 + tail).cast("int").alias("end"), F.lit(label).alias("label"), F.lit(score).alias("score"))
    both = F.flatten(F.transform("starts", lambda x: F.array(span(x, 0, 0, "person", 0.9), span(x, 3, 2, "address", 0.5))))
    n = n.withColumns({"pieces": pieces, "at": at}).withColumn("starts", starts)
    return n.select("ner_id", F.col("text").alias("raw"), both.alias("spans")).filter(F.size("spans") > 0)


def _span_text(s: Column) -> Column:
    return _joined(F.transform(s, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["label"])))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "doctor_report")
    return d.withColumn("body", F.concat_ws(". ", "gerekce", "histolojik_tip", "primer_bolge", "ozet"))


# -- p: quantities ------------------------------------------------------------------------------------------------
def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every reading of a listed quantity in the common unit."""
    return quantities.converted(*(table(spark, sf_dir, t) for t in ("marker", "canonical_term", "quantity_unit", "source_unit")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose number as written is not the number in the common unit."""
    return quantities.differing(p1_values(spark, sf_dir))


# -- flagship -----------------------------------------------------------------------------------------------------
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By reading engine: texts, texts changed by masking, texts that still break a final rule, and mean length."""
    t = spread(table(spark, sf_dir, "ocr_result").select("engine", "text"))
    m = t.withColumn("masked", rules.apply(F.col("text"), [*rules.A1, *rules.A5_FULL, *rules.A8])).withColumn("rule", gate.final_rule(F.col("masked")))
    return m.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.col("text") != F.col("masked")).alias("n_changed"),
        F.count_if(F.col("rule").isNotNull()).alias("n_blocked"),
        F.bround(F.avg(F.length("masked")), 2).alias("mean_chars"),
    )


# -- a: masking ---------------------------------------------------------------------------------------------------
def a11_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the names of the dictionary."""
    return names.mask_names(_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"), "ocr_id", "text")


def a11_names_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the names of the dictionary by all sub-rules, with the sub-rules that applied."""
    docs = _texts(spark, sf_dir).select("ocr_id", "text", F.array().cast("array<string>").alias("removed"))
    return names.mask_all_names(docs, table(spark, sf_dir, "name_lexicon"), "ocr_id", "text", "removed").select("ocr_id", F.col("text").alias("masked"), _joined(F.col("removed")).alias("names_removed"))


def a14_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All masking layers in order, also misread provinces and the dictionary of names, with what they removed."""
    m = engine.masked(spread(_texts(spark, sf_dir)), table(spark, sf_dir, "name_lexicon"), "ocr_id")
    return m.select("ocr_id", "masked", _joined(F.col("fields_removed")).alias("fields_removed"))


def a15_span_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, merged, replaced by the tags of their labels."""
    return _raw(spark, sf_dir).select("ner_id", spans.overlaid(F.col("raw"), spans.merged(F.col("spans"))).alias("masked"))


def a16_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts masked by the spans of a model and of rules together."""
    return hybrid.masked(spread(_texts(spark, sf_dir)), "text", models.offline_entities).select("ocr_id", "masked")


def a17_review_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for a reviewer, every candidate replaced by its number."""
    f = F.transform("candidates", lambda c: F.struct(c.alias("text"), F.lit("person").alias("type")))
    return _spans(spark, sf_dir).select("ner_id", gate.review_text(F.col("text"), f).alias("review"))


def a18_judge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts with one glyph for every tag."""
    return _spans(spark, sf_dir).select("ner_id", gate.neutral(F.col("text")).alias("neutral"))


def a19_report_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with what still names a candidate replaced; here the candidates are the report's own site and a date."""
    d = _report(spark, sf_dir).withColumn("candidates", F.array_compact(F.array("primer_bolge")))
    done = report.redacted(F.col("candidates"))
    return d.select("report_id", *(done[c].alias(c) for c in report.TEXTS), F.array_join(done["redacted_paths"], "|").alias("paths"))


# -- c: functions -------------------------------------------------------------------------------------------------
def c01_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turkish lower and upper case, and lower case with one i."""
    a = F.col("ad")
    return table(spark, sf_dir, "marker").select("marker_id", turkish.fold(a).alias("low"), turkish.fold_dotless(a).alias("dotless"), turkish.upper(a).alias("up"))


def c05_ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms without Turkish marks."""
    return table(spark, sf_dir, "marker").select("marker_id", turkish.ascii_fold(F.col("ad")).alias("plain"))


def _seven_bit(c: Column) -> Column:
    return F.regexp_replace(turkish.ascii_fold(turkish.fold(c)), "[^\\x20-\\x7E\\n]", "?")


def c07_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms within two edits of a word."""
    d = F.levenshtein(_seven_bit(F.col("ad")), F.lit("kreatinin"))
    return table(spark, sf_dir, "marker").select("marker_id", d.alias("distance")).filter("distance <= 2")


def c08_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of the first reading against the second."""
    o = spread(table(spark, sf_dir, "ocr_result").select("ocr_id", "text", "alt_text").filter("text is not null and alt_text is not null"))
    return o.select("ocr_id", metrics.error_rate(_seven_bit(F.col("alt_text")), _seven_bit(F.col("text"))).alias("cer"))


def c09_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each entry of personal data stands in its case, read with errors or not."""
    s = table(spark, sf_dir, "synth_case").select("id", "text", F.posexplode("pii").alias("pos", "needle"))
    return metrics.contains_fuzzy(s, "text", "needle").select("id", "pos", "found")


def c10_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts."""
    return _texts(spark, sf_dir).select("ocr_id", F.sha2(F.encode(F.col("text"), "UTF-8"), 256).alias("sha256"), F.length(F.col("text")).alias("chars"))


def c11_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON in answers that have thoughts, fences or text around it."""
    raw = F.col("result_json")
    odd = F.pmod(F.length(raw), F.lit(3))
    said = F.when(odd == 0, F.concat(F.lit("<think>{}</think>"), raw)).when(odd == 1, F.concat(F.lit("Sonuç:\n```json\n"), raw, F.lit("\n```\nbitti"))).otherwise(F.concat(F.lit("cevap "), raw, F.lit(" son")))
    return table(spark, sf_dir, "jobs").select("id", classify.json_of(said).alias("json"))


def c12_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of stored results; a cut one has none."""
    j = F.from_json("result_json", "durum string, sayfa int, guven double")
    whole = F.col("result_json").rlike("\\}$")
    return table(spark, sf_dir, "jobs").select("id", F.when(whole, j["durum"]).alias("durum"), F.when(whole, j["sayfa"]).alias("sayfa"), F.when(whole, j["guven"]).alias("guven"))


def c14_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences forced between 0 and 1."""
    x = F.when(F.col("report_id") % 7 == 0, F.lit("yok")).otherwise((F.col("guven") * 3 - 1).cast("string"))
    return table(spark, sf_dir, "doctor_report").select("report_id", F.bround(classify.clamped(x), 6).alias("confidence"))


def c15_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories from free entries."""
    raw = F.when(F.col("report_id") % 3 == 0, F.lower(F.translate("kategori", "_", " "))).when(F.col("report_id") % 3 == 1, F.concat(F.lower("kategori"), F.lit(" cancer"))).otherwise(F.col("primer_bolge"))
    return table(spark, sf_dir, "doctor_report").select("report_id", classify.category(F.coalesce(raw, F.lit(""))).alias("category"))


def c16_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the confidence after checks against the text."""
    v = classify.validated(F.col("kategori"), F.coalesce("guven", F.lit(0.0)), F.col("body"), F.col("primer_bolge"))
    return _report(spark, sf_dir).withColumn("v", v).select("report_id", "v.best_category", F.array_join("v.keyword_matches", "|").alias("matches"), F.size("v.warnings").alias("n_warnings"), "v.is_valid", "v.confidence_adjusted")


def c17_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque names of files."""
    return table(spark, sf_dir, "jobs").select("id", F.concat(F.substring("id", 1, 8), jobs.suffix(F.col("filename"))).alias("opaque"))


def c22_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data addresses of texts."""
    return _texts(spark, sf_dir).filter("text is not null").select("ocr_id", F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode(F.col("text"), "UTF-8")), "[\\r\\n]", "")).alias("address"))


# -- f: filters ---------------------------------------------------------------------------------------------------
def f01_min_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with enough in them."""
    bare = F.regexp_replace(F.col("text"), "^[ \\t\\n\\f]+|[ \\t\\n\\f]+$", "")
    return _texts(spark, sf_dir).filter(F.length(bare) >= 20).select("ocr_id", F.length(bare).alias("chars"))


def f02_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the kinds that are taken."""
    return table(spark, sf_dir, "jobs").filter(jobs.suffix(F.col("filename")).isin(".pdf", ".png", ".jpg")).select("id", "filename")


def f04_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs to be reviewed."""
    return table(spark, sf_dir, "jobs").filter("status = 'needs_review'").select("id", "filename", "ref")


def f05_medical_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are medical words or forms only."""
    m = table(spark, sf_dir, "marker").select("marker_id", F.col("ad").alias("span"))
    return m.select("marker_id", gate.looks_medical(F.col("span")).alias("medical"))


def f06_finding_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each span's text still stands in the masked form."""
    s = _spans(spark, sf_dir).select("ner_id", "text", F.posexplode("candidates").alias("pos", "c"))
    return s.select("ner_id", "pos", gate.is_real(F.col("c"), F.col("text")).alias("is_real"))


def f07_label_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that have only labels."""
    return names.lines(_texts(spark, sf_dir), "ocr_id", "text").filter(gate.is_label_only(F.col("line"))).select("ocr_id", "line_no", "line")


def f08_self_refute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose reason says that they are none."""
    f = table(spark, sf_dir, "doctor_report").select("report_id", F.posexplode("onemli_bulgular").alias("pos", "b"))
    return f.select("report_id", "pos", gate.is_self_refuting(F.col("b.kanit"), F.col("b.madde")).alias("refuted"))


def f09_medical_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are codes or tests."""
    return table(spark, sf_dir, "marker").select("marker_id", gate.is_medical_code(F.col("ad"), F.lit("other")).alias("code"))


def f10_hide_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with stars for their text."""
    f = F.transform("spans", lambda s: F.struct(s["text"].alias("text"), s["label"].alias("type"), F.lit("ner").alias("source")))
    h = _spans(spark, sf_dir).select("ner_id", F.explode(gate.hidden(f, "masked")).alias("h"))
    return h.select("ner_id", "h.n", "h.type", "h.chars", F.col("h.text").alias("shown"))


def f12_provider_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of allowed providers, beside those of the audit log that are none."""
    known = F.create_map(*(F.lit(x) for kv in gate.PROVIDERS.items() for x in kv))
    got = table(spark, sf_dir, "egress_audit").select("host").distinct()
    return got.select("host", F.array_contains(F.map_values(known), F.col("host")).alias("allowed"))


def f13_final_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first final rule that each text breaks."""
    return _texts(spark, sf_dir).select("ocr_id", gate.final_rule(F.col("text")).alias("rule"))


def f14_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions to let masked forms out."""
    d = gate.decision(F.col("text"), F.size("spans") < 4, F.col("candidates"))
    return _spans(spark, sf_dir).filter("text is not null").select("ner_id", d.alias("d")).select("ner_id", "d.allowed", F.array_join("d.reasons", "|").alias("reasons"), "d.text_sha256", "d.chars")


def f15_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why reports should be looked at again."""
    r = report.review_reasons(F.col("okunabilirlik"), F.col("malignite_durumu"), F.col("guven"), F.col("guven") * 0.7, F.size("belirsizlikler") > 0, F.lit(False))
    return table(spark, sf_dir, "doctor_report").select("report_id", _joined(r).alias("reasons"))


def f17_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that contradict their category."""
    return _report(spark, sf_dir).select("report_id", _joined(classify.contradictions(F.col("body"), F.col("kategori"), F.coalesce("primer_bolge", F.lit("")))).alias("warnings"))


# -- g: aggregates ------------------------------------------------------------------------------------------------
def g01_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status."""
    return table(spark, sf_dir, "jobs").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def g02_log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms masked, mean fields removed and mean characters; 0 for an empty log."""
    n = table(spark, sf_dir, "ner_result")
    return n.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bround(F.avg(F.size("fields_removed")), 1), F.lit(0.0)).alias("mean_fields"), F.coalesce(F.bround(F.avg(F.length("text")), 2), F.lit(0.0)).alias("mean_chars"))


def g03_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by category: count, mean confidence, share with a sure one."""
    d = table(spark, sf_dir, "doctor_report").groupBy("kategori").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("guven"), 3).alias("mean_confidence"), F.bround(F.try_divide(F.sum(F.when(F.col("guven") >= 0.5, 1.0).otherwise(0.0)), F.count(F.lit(1))), 3).alias("sure_rate"))
    return d.orderBy(F.desc("n"), "kategori")


def g04_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each category after every report."""
    d = table(spark, sf_dir, "doctor_report").filter("guven is not null")
    return jobs.running_means(d, "kategori", "guven", ["report_id"]).select("report_id", "kategori", F.bround("running_mean", 9).alias("running_mean"))


def g05_bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By engine: readings, those without text, mean and upper median of completeness, ratio of sums, times."""
    o = table(spark, sf_dir, "ocr_result")
    g = o.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("n_empty"),
        F.bround(F.avg("completeness"), 3).alias("mean_completeness"),
        metrics.rate(F.length("text"), F.length("alt_text")).alias("read_rate"),
        F.bround(F.avg("seconds"), 2).alias("mean_seconds"),
        F.count_if(F.size("warnings") > 0).alias("n_warned"),
    )
    return g.join(metrics.upper_median(o, ["engine"], "completeness"), "engine", "left")


def g06_bench_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by engine, and by engine and pages."""
    o = table(spark, sf_dir, "ocr_result").select("engine", "pages", "completeness", F.length("text").alias("a"), F.length("alt_text").alias("b"))
    g = o.groupingSets([["engine"], ["engine", "pages"]], "engine", "pages")
    return g.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.bround(F.avg("completeness"), 3).alias("mean_completeness"), metrics.rate(F.col("a"), F.col("b")).alias("read_rate"))


def g07_keyword_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category with most keywords in each text, the first among equals."""
    b = classify.best(classify.evidence(F.col("text")))
    return _texts(spark, sf_dir).select("ocr_id", b["category"].alias("category"), b["score"].alias("score"))


def g08_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct capital words and numbers of each text."""
    return _texts(spark, sf_dir).select("ocr_id", F.size(gate.tokens(F.col("text"))).alias("n_tokens"))


def g09_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch: done, failed, fields removed."""
    j = table(spark, sf_dir, "jobs").agg(F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    n = table(spark, sf_dir, "ner_result").agg(F.coalesce(F.sum(F.size("fields_removed")), F.lit(0)).alias("n_fields"))
    return j.join(F.broadcast(n))


def g10_quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By host: whether all, and whether any, was allowed."""
    return table(spark, sf_dir, "egress_audit").groupBy("host").agg(F.bool_and("allowed").alias("all_allowed"), F.bool_or("allowed").alias("any_allowed"))


def g11_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and slash numbers in each text."""
    return _texts(spark, sf_dir).select("ocr_id", F.regexp_count(F.col("text"), F.lit("[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}")).alias("n_dates"), F.regexp_count(F.col("text"), F.lit("[0-9]{5}/[0-9]{2}")).alias("n_protocols"))


# -- j: joins -----------------------------------------------------------------------------------------------------
def j01_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words that are a name of the dictionary."""
    return names.name_pairs(_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"), "ocr_id", "text")


def j03_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the ending of a surname."""
    n = table(spark, sf_dir, "name_lexicon")
    return n.select("token", F.exists(F.array(*map(F.lit, names.SUFFIXES)), lambda s: F.endswith(F.col("token"), s)).alias("has_ending"))


def j04_misread_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in capitals that are a province read with errors."""
    return names.misread_places(_texts(spark, sf_dir), "ocr_id", "text")


def j05_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provinces named in each text."""
    return _texts(spark, sf_dir).select("ocr_id", _joined(names.exact_places(F.col("text"))).alias("places"))


def j06_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of medical sections in each text."""
    s = names.in_sections(F.col("text"))
    return _texts(spark, sf_dir).filter("text is not null").select("ocr_id", F.size(s).alias("n_lines"), F.size(F.filter(s, lambda x: x)).alias("n_medical"))


def j07_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, or words of them, that still stand in the masked form."""
    return _spans(spark, sf_dir).filter("text is not null").select("ner_id", _joined(gate.remaining(F.col("candidates"), F.col("text"))).alias("remaining"))


def j08_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each category in each text."""
    e = _texts(spark, sf_dir).select("ocr_id", F.explode(classify.evidence(F.col("text"))).alias("e"))
    return e.select("ocr_id", "e.category", _joined(F.col("e.keywords")).alias("keywords"), "e.score")


def j09_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every engine with every host (both few)."""
    e = table(spark, sf_dir, "ocr_result").select("engine").distinct()
    h = table(spark, sf_dir, "egress_audit").select("host").distinct()
    return e.join(F.broadcast(h))


def j10_longest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of the longest organ word in each entry."""
    return table(spark, sf_dir, "doctor_report").select("report_id", classify.category(F.coalesce("primer_bolge", F.lit(""))).alias("category"))


def j11_labelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of labelled lines that begin with a first name."""
    return names.labelled_values(_texts(spark, sf_dir), table(spark, sf_dir, "name_lexicon"), "ocr_id", "text")


def j12_page_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of both readings put side by side: of each page the first reading where it has more than 50 characters, else the
    second, and which it was."""
    o = table(spark, sf_dir, "ocr_result")
    pages = lambda c: o.select(F.col("ocr_id").cast("string").alias("path"), F.posexplode(F.split(c, "\f", -1)).alias("page_no", "text"))
    p = files.paged(pages("text"), pages("alt_text").withColumn("engine", F.lit("ikincil")))
    return p.select(F.col("path").cast("long").alias("ocr_id"), "page_no", "engine", F.length("text").alias("chars"))


# -- k, s: written and read back ----------------------------------------------------------------------------------
def k01_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts written as a file each, and read as files: the key, the bytes and the text of each."""
    path = scratch(spark, "texts")
    n = table(spark, sf_dir, "ner_result").filter("text is not null and text <> ''").select("ner_id", "text")
    sinks.text_files(n, "ner_id", "text", path)
    got = files.files(spark, path)
    read = files.texts(got).select("path", F.regexp_replace("text", "\\n$", "").alias("text"))
    key = F.regexp_extract("path", "key=([0-9]+)/", 1).cast("long")
    return got.select("path", "length").join(read, "path").select(key.alias("ner_id"), F.col("length").alias("bytes"), "text")


def k03_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of maskings, appended twice, and its statistics."""
    path = scratch(spark, "log")
    n = table(spark, sf_dir, "ner_result").select("ner_id", "job_id", F.size("fields_removed").alias("n_fields"), F.length("text").alias("chars"))
    for _ in range(2):
        sinks.append(n, path)
    return spark.read.parquet(path).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_fields").alias("n_fields"), F.sum("chars").alias("chars"))


def k04_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of categories appended, and the statistics that follow from it."""
    path = scratch(spark, "categories")
    sinks.append(table(spark, sf_dir, "doctor_report").select("report_id", "kategori", "guven"), path)
    m = jobs.means(spark.read.parquet(path), "kategori", "guven")
    return m.select("kategori", "total_count", F.bround("avg_confidence", 6).alias("avg_confidence"))


def k05_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on masked forms, allowed and denied, as rows of the audit log, written and read back."""
    path = scratch(spark, "audit")
    d = _spans(spark, sf_dir).withColumn("job_id", F.col("ner_id").cast("string")).withColumn("decision", gate.decision(F.col("text"), F.size("spans") < 4, F.col("candidates")))
    sinks.append(gate.audited(d, F.lit("api.anthropic.com"), F.lit("m")), path)
    return spark.read.parquet(path).select("job_id", "allowed", _joined(F.col("reasons")).alias("reasons"), "text_sha256", "chars", "host", "model")


def k06_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as one CSV file with a header, in order of time, and read back."""
    path = scratch(spark, "csv")
    j = table(spark, sf_dir, "jobs").select(F.unix_micros("created_at").alias("created_us"), "id", "status", "filename", "ref", "size_bytes")
    sinks.csv_export(j, "created_us", path)
    got = spark.read.csv(path, header=True)
    return got.select(F.col(got.columns[0]).cast("long").alias("created_us"), "id", "status", "filename", "ref", F.col("size_bytes").cast("long").alias("size_bytes"))


def s06_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that have too little of the second one."""
    return table(spark, sf_dir, "ocr_result").select("ocr_id", _joined(files.warnings(F.col("text"), F.col("alt_text"))).alias("warnings"))


def s08_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that land in a folder, taken in batches by a stream that leaves out those above a size."""
    path = scratch(spark, "landing")
    n = table(spark, sf_dir, "ner_result").filter("text is not null and text <> ''").select("ner_id", "text")
    sinks.text_files(n, "ner_id", "text", f"{path}/in")
    landed = stream.landing(spark, f"{path}/in/*", most_files=1_000, most_bytes=1_500)
    stream.write_batches(landed, f"{path}/out", f"{path}/checkpoint", lambda df: df.select("path", "length")).awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.regexp_extract("path", "key=([0-9]+)/", 1).cast("long").alias("ner_id"), F.col("length").alias("bytes"))


def s14_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their truth: a list of files written as JSON, and beside it a text for each."""
    path = scratch(spark, "manifest")
    c = table(spark, sf_dir, "synth_case").select("id", "kind", F.concat("id", F.lit(".png")).alias("file"), "text")
    files.write_manifest(c, path)
    return files.manifest(spark, path).select("id", "kind", "file", F.col("truth").alias("text"))


def c18_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of jobs to the second."""
    return table(spark, sf_dir, "jobs").select("id", F.unix_micros(jobs.to_seconds(F.col("created_at"))).alias("created_us"))


# -- k, o, s ------------------------------------------------------------------------------------------------------
def k05_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log by host and reason, exact repeats counted once."""
    a = table(spark, sf_dir, "egress_audit").distinct().select("host", "allowed", F.explode_outer("reasons").alias("reason"))
    return a.groupBy("host", "reason").agg(F.count(F.lit(1)).alias("n"))


def k07_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports' markers as JSON."""
    return table(spark, sf_dir, "doctor_report").select("report_id", F.to_json(F.transform("belirtecler", lambda b: b["ad"])).alias("json"))


def k08_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as text."""
    return table(spark, sf_dir, "doctor_report").select("report_id", report.markdown().alias("markdown"))


def o01_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest jobs."""
    return jobs.recent(table(spark, sf_dir, "jobs")).select("id", "status", "filename", "ref", "size_bytes")


def o02_recent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest failed jobs."""
    return jobs.recent(table(spark, sf_dir, "jobs"), 20, "failed").select("id", "status", "filename")


def o03_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log in order of time."""
    return table(spark, sf_dir, "egress_audit").distinct().orderBy("ts", "text_sha256").select(F.unix_micros("ts").alias("ts_us"), "host", "allowed", "text_sha256", "chars")


def o04_groups_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs by how many jobs they have."""
    return table(spark, sf_dir, "jobs").groupBy("ref").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ref")


def o05_span_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in order."""
    return _raw(spark, sf_dir).select("ner_id", _span_text(spans.ordered(F.col("spans"))).alias("spans"))


def o06_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of each term, the longest first."""
    a = F.array_sort("aliases", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return table(spark, sf_dir, "canonical_term").select("term_id", _joined(a).alias("aliases"))


def o07_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings and the beginning of refs."""
    return _spans(spark, sf_dir).select("ner_id", _joined(F.slice("candidates", 1, 2)).alias("some"), F.left(F.coalesce(F.col("text"), F.lit("")), F.lit(64)).alias("head"))


def s03_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions of pages of many sizes within a budget of pixels."""
    return table(spark, sf_dir, "jobs").select("id", files.resolution((F.col("size_bytes") % 90 + 5).cast("double"), (F.col("size_bytes") % 110 + 7).cast("double")).alias("dpi"))


def s06_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading to use, and how complete the first one is."""
    o = table(spark, sf_dir, "ocr_result")
    return o.select("ocr_id", F.length(files.routed(F.col("text"), F.col("alt_text"), 400)).alias("chars"), files.completeness(F.col("text"), F.col("alt_text")).alias("completeness"), F.array_join(F.array_sort(F.array_distinct("page_engines")), "+").alias("engines"))


def s10_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the dictionary in both spellings."""
    return names.dictionary(table(spark, sf_dir, "name_lexicon")).select("word", "is_first", "is_surname")


def s12_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up forms."""
    return files.forms(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))


# -- t, u, w, x ---------------------------------------------------------------------------------------------------
def t00_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through all stages: whether they passed the gate, and why they may not go out."""
    o = spread(table(spark, sf_dir, "ocr_result").select("ocr_id", "text", "alt_text"))
    names = table(spark, sf_dir, "name_lexicon")
    d = pipeline.decided(pipeline.masked(o, names, "ocr_id"), other="alt_text", lexicon=names)
    return d.select("ocr_id", "gate.passed", F.size("gate.findings").alias("n_findings"), "decision.allowed", _joined(F.col("decision.reasons")).alias("reasons"))


def g12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind of case: personal entries left and medical terms lost by rules and dictionary, and the gate's answer."""
    c = spread(table(spark, sf_dir, "synth_case").select("id", "kind", "text", "pii", "keep"))
    names = table(spark, sf_dir, "name_lexicon")
    d = pipeline.decided(pipeline.masked(c, names, "id"), lexicon=names)
    return metrics.leaks(d.withColumn("passed", F.col("gate.passed")), ["kind"], passed="passed")


def t01_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over masked forms."""
    g = gate.checked(spread(_spans(spark, sf_dir)), "text", "candidates", lexicon=table(spark, sf_dir, "name_lexicon"))
    return g.select("ner_id", "gate.passed", F.size("gate.findings").alias("n_findings"))


def t02_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules for residues find in masked forms."""
    people = gate.dictionary_names(table(spark, sf_dir, "name_lexicon"))
    r = _spans(spark, sf_dir).select("ner_id", F.explode(gate.residual(F.col("text"), people)).alias("f"))
    return r.groupBy("ner_id", "f.type").agg(F.count(F.lit(1)).alias("n"))


def t05_cross_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings for candidates of another reading."""
    c = _spans(spark, sf_dir).select("ner_id", F.explode(gate.crossed(F.col("candidates"), F.col("text"))).alias("f"))
    return c.select("ner_id", F.col("f.text").alias("finding"), "f.type")


def u01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of spans and of deleted tokens together."""
    o = table(spark, sf_dir, "ner_result").select("ner_id", F.array_union(F.transform("spans", lambda s: s["text"]), F.coalesce("fields_removed", F.array())).alias("u"))
    return o.select("ner_id", F.array_join(F.array_sort("u"), "|").alias("candidates"))


def u02_deleted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that masking took away."""
    after = rules.apply(F.col("text"), [*rules.A1, *rules.A5_FULL, *rules.A8])
    return _texts(spark, sf_dir).filter("text is not null").withColumn("after", after).select("ocr_id", _joined(gate.deleted_tokens(F.col("text"), F.col("after"))).alias("deleted"))


def u03_all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First names and surnames as one set."""
    n = table(spark, sf_dir, "name_lexicon")
    return n.filter("is_first").select("token").union(n.filter("is_surname").select("token")).distinct()


def u04_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and engines of each reading in one list, repeats kept."""
    return table(spark, sf_dir, "ocr_result").select("ocr_id", _joined(F.concat("warnings", "page_engines")).alias("bag"))


def w01_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words over all texts."""
    p = names.pairs(names.lines(_texts(spark, sf_dir), "ocr_id", "text"), "ocr_id")
    return p.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def w02_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 14 lines of each text."""
    return _texts(spark, sf_dir).select("ocr_id", F.array_join(F.slice(F.split(F.col("text"), "\n", -1), 1, 14), "\n").alias("header"))


def w03_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in chunks of a budget of words."""
    return spans.chunks(_texts(spark, sf_dir), "ocr_id", "text", 60)


def w03_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their chunks, each at its place."""
    c = w03_chunks(spark, sf_dir).groupBy("ocr_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "offset", "chunk"))).alias("c"))
    ends = F.aggregate("c", F.lit(0), lambda a, x: F.when(x["offset"] == a, a + F.length(x["chunk"])).otherwise(F.lit(-1_000_000_000)))
    return c.select("ocr_id", F.array_join("c.chunk", "").alias("text"), (ends >= 0).alias("in_place"))


def w04_merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans as one."""
    return _raw(spark, sf_dir).select("ner_id", _joined(F.transform(spans.merged(F.col("spans")), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))).alias("merged"))


def w05_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their numbers."""
    return _spans(spark, sf_dir).select("ner_id", F.explode(spans.numbered(F.col("candidates"))).alias("x")).select("ner_id", "x.n", F.col("x.item").alias("candidate"))


def w06_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are mostly in capitals, which get a second pass in small letters."""
    up = F.regexp_count(F.col("text"), F.lit("[A-ZÇĞİÖŞÜ]"))
    low = F.regexp_count(F.col("text"), F.lit("[a-zçğıöşü]"))
    return _texts(spark, sf_dir).filter("text is not null").select("ocr_id", (up > low).alias("capitals"))


def w08_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last audit row of each job."""
    return jobs.latest(table(spark, sf_dir, "egress_audit"), "job_id", "ts", ["text_sha256", "host", "chars"]).select("job_id", "host", "allowed", "text_sha256", "chars")


def x04_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status after a restart."""
    return jobs.stale(table(spark, sf_dir, "jobs")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def x09_stream_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by category, kept by a stream over the reports."""
    path = scratch(spark, "stream")
    src = f"{sf_dir}/doctor_report.parquet"
    schema = spark.read.parquet(src).select("kategori", "guven").schema
    q = stream.running_means(stream.rows(spark, f"{src}*", schema), "kategori", "guven", f"{path}/out", f"{path}/checkpoint")
    q.awaitTermination()
    return stream.current_means(spark, f"{path}/out", "kategori").select("kategori", "total_count", F.bround("avg_confidence", 6).alias("avg_confidence"))


def queries():
    """All queries by name."""
    own = {k: v for k, v in globals().items() if getattr(v, "__module__", "") == __name__ and k != "queries" and k[0] != "_"}
    return own | {name: partial(_layer, k) for k, name in LAYERS.items()}
