"""Plans: what must not exchange rows does not, filters and columns reach the scan, nothing that grows is broadcast."""

import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a17_review_mask", "a18_judge_view", "a19_report_redact", "c01_fold", "c15_category", "c16_confidence", "f13_final_rules", "f14_egress", "g07_keyword_argmax", "j06_sections", "j07_candidates", "k08_markdown", "o05_span_order", "t02_residual_rows", "u02_deleted_tokens", "w02_header", "w04_merge_spans"])
def test_within_the_row(name, spark, small):
    if name == "t02_residual_rows":
        from pyspark.sql import functions as F

        from tahlil.operators import gate

        df = spark.read.parquet(f"{small}/ner_result.parquet").select("ner_id", gate.residual(F.col("text")).alias("f"))
    else:
        df = QUERIES[name](spark, small)
    assert "Exchange" not in plan(df) and "Python" not in plan(df) and "InArrow" not in plan(df)


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["f04_status"](spark, small))
    assert "EqualTo(status,needs_review)" in text and "ReadSchema: struct<id:string,status:string,filename:string,ref:string>" in text
    assert "ReadSchema: struct<status:string>" in plan(QUERIES["g01_status_counts"](spark, small))


def test_one_exchange_for_grouped_counts(spark, small):
    assert plan(QUERIES["w01_bigrams"](spark, small)).count("Exchange hashpartitioning") == 1
    assert plan(QUERIES["w08_latest_state"](spark, small)).count("Exchange hashpartitioning") == 1


def test_names_are_found_without_an_exchange_of_words(spark, small):
    text = plan(QUERIES["j01_name_pairs"](spark, small))
    assert "BroadcastHashJoin" in text and "Window" not in text and "SortMergeJoin" not in text
