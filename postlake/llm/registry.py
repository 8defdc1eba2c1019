"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, exact_dedup, fill_middle, fingerprint, html_text, mixing, near_dedup, personal_data, resampling, secret_scan, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_html": html_text.op10_html,
    "op11_resampling": resampling.op11_resampling,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_personal_data": personal_data.op13_personal_data,
}

SQL = {"op4_exact_dedup": exact_dedup.SQL, "op12_fill_in_middle": fill_middle.SQL}
