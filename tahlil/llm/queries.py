"""Queries of the llm problems; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tahlil.llm import canonical, mixture, personal, scanned, skeleton, split, subjects, tokens
from tahlil.operators import metrics
from tahlil.session import table


def p2_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry each typed value stands for."""
    typed = canonical.values(table(spark, sf_dir, "marker"), table(spark, sf_dir, "doctor_report"))
    return canonical.mapped(typed, table(spark, sf_dir, "canonical_term"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the values that are not letter for letter a term."""
    return canonical.found(p2_mapped(spark, sf_dir), table(spark, sf_dir, "canonical_term"))


def p2_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that stand for no entry."""
    return canonical.misses(p2_mapped(spark, sf_dir))


def p2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the values that are letter for letter a term."""
    return p2_mapped(spark, sf_dir).filter("cost = 0").join(F.broadcast(table(spark, sf_dir, "canonical_term").select("field", F.col("term").alias("value")).distinct()), ["field", "value"]).select("field", "rec_id", "term_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in pieces of at most 2,000 characters."""
    return split.split(split.texts(table(spark, sf_dir, "ocr_result"), table(spark, sf_dir, "ner_result")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that had to be cut."""
    return split.oversized(p3_pieces(spark, sf_dir))


def p3_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their pieces."""
    return split.joined(p3_pieces(spark, sf_dir))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text and every entry of personal data."""
    return skeleton.formed(skeleton.entries(table(spark, sf_dir, "ocr_result"), table(spark, sf_dir, "synth_case")), "text")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals grouped by equal form."""
    return skeleton.groups(p4_forms(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and entries with at least one look-alike character."""
    return p4_forms(spark, sf_dir).filter(skeleton.changed("text")).select("tbl", "rec_key", "pos")


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with the personal data found in them, and with placeholders in its place."""
    some = personal.texts(*(table(spark, sf_dir, t) for t in ("ocr_result", "synth_case", "ner_result")))
    return personal.masked(some, table(spark, sf_dir, "name_lexicon"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal data."""
    some = personal.texts(*(table(spark, sf_dir, t) for t in ("ocr_result", "synth_case", "ner_result")))
    return personal.found(personal.located(some, table(spark, sf_dir, "name_lexicon")))


def p5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind of case: personal entries left and medical terms lost in the texts with placeholders."""
    cases = table(spark, sf_dir, "synth_case")
    done = p5_texts(spark, sf_dir).filter("tbl = 'synth_case'").select(F.col("rec_key").alias("id"), "masked")
    return metrics.leaks(cases.join(done, "id"), ["kind"])


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of each page repaired."""
    return scanned.repaired(table(spark, sf_dir, "ocr_result"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with cut words, misread words, repeated headings and page numbers."""
    return scanned.found(p6_texts(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts decoded again from the ids; null texts come back empty."""
    return tokens.decode(p7_ids(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, a row per slot."""
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return mixture.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p8_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, to three places."""
    return p8_shares(spark, sf_dir).select("source", F.bround("share", 3).alias("share"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.mixed(*(table(spark, sf_dir, t) for t in ("documents", "subject_label", "subject_area")))


def p9_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject mixture of every notebook."""
    return subjects.mixture_of_documents(_mixed(spark, sf_dir), table(spark, sf_dir, "subject_area"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects each notebook is about."""
    return subjects.found(_mixed(spark, sf_dir))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: notebooks by source and subject."""
    return subjects.composition(_mixed(spark, sf_dir), table(spark, sf_dir, "documents"))


def queries():
    """All queries of this module by name."""
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
