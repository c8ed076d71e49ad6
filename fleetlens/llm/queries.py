"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from fleetlens.llm import audit, decontaminate, frames, html, langid, lines, minhash, mixing, quality, simhash, substrings, tokens, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_near_dedup": minhash.op3_near_dedup,
    "op4_language": langid.op4_language,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_text": html.op7_html_text,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_token_counts": tokens.op10_token_counts,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_fill_in_middle": frames.op12_fill_in_middle,
    "op13_simhash": simhash.op13_simhash,
}

ORACLE: dict[str, str] = {
    "op2_quality": quality.OP2_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op9_substring_dedup": substrings.OP9_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_fill_in_middle": frames.OP12_SQL,
}
