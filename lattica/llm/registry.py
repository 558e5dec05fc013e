"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lattica.llm import align, decontaminate, host_rules, jaccard, lines, mixing, phrases, substrings, token_counts, token_files, topk, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_topk": topk.op3_topk,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substrings": substrings.op6_substrings,
    "op7_fuzzy_lines": lines.op7_fuzzy_lines,
    "op8_token_files": token_files.op8_token_files,
    "op9_mixing": mixing.op9_mixing,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_phrases": phrases.op11_phrases,
    "op12_align": align.op12_align,
    "op13_host_rules": host_rules.op13_host_rules,
}
ORACLE_SQL = {"op1_warc": warc.SQL, "op3_topk": topk.SQL, "op4_decontaminate": decontaminate.SQL, "op11_phrases": phrases.SQL, "op13_host_rules": host_rules.SQL}
