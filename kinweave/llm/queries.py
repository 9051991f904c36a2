"""The queries of this subpackage, by name, and the SQL that states their rows."""

from __future__ import annotations

from kinweave.llm import decontam, htmltext, linededup, lmscore, mixing, neardup, quality, suffix_dedup, toxicity, urlfilter

QUERIES = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_html_text": htmltext.op2_html_text,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_substring_dedup": suffix_dedup.op7_substring_dedup,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_lm_score": lmscore.op10_lm_score,
}

SQL = {
    "op4_line_dedup": linededup.OP4_SQL,
    "op6_source_mix": mixing.OP6_SQL,
    "op9_url_filter": urlfilter.OP9_SQL,
}
