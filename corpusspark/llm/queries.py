"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from corpusspark.llm import chat, dedup_exact, html_text, jaccard_join, language, mixing, pieces, pii, quality, token_align, toxicity, url_rules, word_runs


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_exact_dedup": dedup_exact.op2_exact_dedup,
        "op3_chat_format": chat.op3_chat_format,
        "op4_language_id": language.op4_language_id,
        "op5_url_rules": url_rules.op5_url_rules,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_pii_spans": pii.op8_pii_spans,
        "op9_pieces": pieces.op9_pieces,
        "op10_main_text": html_text.op10_main_text,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_token_align": token_align.op12_token_align,
        "op13_word_runs": word_runs.op13_word_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": dedup_exact.SQL,
        "op3_chat_format": chat.SQL,
        "op5_url_rules": url_rules.SQL,
    }
