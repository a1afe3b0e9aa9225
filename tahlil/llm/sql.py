"""SQL of the llm queries that SQL can express."""

from __future__ import annotations

SQL = {
    "p3_found": """
        SELECT 'ocr_result' AS tbl, CAST(ocr_id AS VARCHAR) AS rec_key FROM ocr_result WHERE length(text) > 2000
        UNION ALL
        SELECT 'ner_result', CAST(ner_id AS VARCHAR) FROM ner_result WHERE length(text) > 2000""",
    # a value that is a term stands for that term
    "p2_exact": """
        SELECT v.field AS field, v.rec_id AS rec_id, t.term_id AS term_id FROM (
            SELECT 'ad' AS field, marker_id AS rec_id, ad AS value FROM marker
            UNION ALL SELECT 'histolojik_tip', report_id, histolojik_tip FROM doctor_report
            UNION ALL SELECT 'primer_bolge', report_id, primer_bolge FROM doctor_report) v
        JOIN canonical_term t ON t.field = v.field AND t.term = v.value""",
    # pieces without their overlaps are the texts
    "p3_joined": """
        SELECT 'ocr_result' AS tbl, CAST(ocr_id AS VARCHAR) AS rec_key, text FROM ocr_result WHERE text IS NOT NULL
        UNION ALL
        SELECT 'ner_result', CAST(ner_id AS VARCHAR), text FROM ner_result WHERE text IS NOT NULL""",
    # every source reaches its weight
    "p8_reached": "SELECT source, CAST(round_even(weight / sum(weight) OVER (), 3) AS DOUBLE) AS share FROM mix_target",
    # decoding what was encoded gives the texts back
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
