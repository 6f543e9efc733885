"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from . import decontam, exact_dedup, jaccard_join, line_dedup, packing, quality, suffix_dedup, toxicity, url_filter, warc
from .common import table

QUERIES = {
    "op1_line_dedup": lambda spark, d: line_dedup.repeats(table(spark, d, "documents")),
    "op2_decontamination": lambda spark, d: decontam.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op3_warc_salvage": lambda spark, d: warc.round_trip(table(spark, d, "pages")),
    "op4_url_filter": lambda spark, d: url_filter.judge_urls(table(spark, d, "pages")),
    "op5_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents")).drop("keep_locator", "locator"),
    "op6_suffix_dedup": lambda spark, d: suffix_dedup.remove_repeats(table(spark, d, "documents")),
    "op7_best_fit_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op8_jaccard_join": lambda spark, d: jaccard_join.jaccard_components(table(spark, d, "documents")),
    "op9_ordinal_quality": lambda spark, d: quality.quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_toxicity_fm": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_warc_salvage": warc.oracle(),
    "op4_url_filter": url_filter.oracle(),
    "op5_exact_dedup": """WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
}
