"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import bm25, decontaminate, line_dedup, lm_score, mixing, near_dup, quality, suffix_dedup, toxicity, url_filter


def queries():
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_quality": quality.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_bm25_top_k": bm25.query,
        "op5_near_dup_join": near_dup.query,
        "op6_mix_sources": mixing.query,
        "op7_url_filter": url_filter.query,
        "op8_lm_score": lm_score.query,
        "op9_toxicity": toxicity.query,
        "op10_line_dedup": line_dedup.query,
    }


def oracle_sql():
    return {
        "op6_mix_sources": mixing.oracle(),
        "op10_line_dedup": line_dedup.oracle(),
    }
