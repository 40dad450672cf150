"""The queries of this subpackage, by name, and the SQL that tells their results where SQL can."""

from __future__ import annotations

from . import chat_format, classifier, exact_dedup, html_extract, mixing, packing, quality_rules, simhash, suffix_dedup, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_warc": warc.op2_warc,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_classifier": classifier.op4_classifier,
    "op5_html": html_extract.op5_html,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_packing": packing.op7_packing,
    "op8_chat": chat_format.op8_chat,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {"op2_warc": warc.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op8_chat": chat_format.ORACLE}
