"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from scoreloom.llm import chat, hard_negatives, html_extract, mixing, packing, pii, quality, runs, sentencepiece_lattice, simhash, token_store, topk, url_filter


def queries() -> dict:
    return {
        "op1_packing": packing.op1,
        "op2_quality_rules": quality.op2,
        "op3_html_extraction": html_extract.op3,
        "op4_simhash_near_dedup": simhash.op4,
        "op5_chat_formatting": chat.op5,
        "op6_url_filters": url_filter.op6,
        "op7_sentencepiece": sentencepiece_lattice.op7,
        "op8_token_binary": token_store.op8,
        "op9_pii_surrogates": pii.op9,
        "op10_exact_topk": topk.op10,
        "op11_hard_negatives": hard_negatives.op11,
        "op12_mixing": mixing.op12,
        "op13_periodic_runs": runs.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.ORACLE2,
        "op5_chat_formatting": chat.ORACLE5,
        "op6_url_filters": url_filter.ORACLE6,
        "op10_exact_topk": topk.ORACLE10,
        "op11_hard_negatives": hard_negatives.ORACLE11,
    }
