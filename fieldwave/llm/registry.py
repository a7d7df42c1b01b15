"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, hard_negatives, license_scan, line_dedup, merkle, mixing, near_dedup, quality, token_files, url_rules, warc

QUERIES = {
    "op1_bm25_wand": decontaminate.query,
    "op2_warc_dictionary": warc.query,
    "op3_line_runs": line_dedup.query,
    "op4_chat_events": chat.query,
    "op5_hyperminhash": near_dedup.query,
    "op6_token_dac": token_files.query,
    "op7_exact_tree_merge": exact_dedup.query,
    "op8_url_rules": url_rules.query,
    "op9_mix_prefix_sums": mixing.query,
    "op10_quality_mil": quality.query,
    "op11_merkle_log": merkle.query,
    "op12_strassen_negatives": hard_negatives.query,
    "op13_license_automata": license_scan.query,
}
SQL = {
    "op2_warc_dictionary": warc.SQL,
    "op3_line_runs": line_dedup.SQL,
    "op4_chat_events": chat.SQL,
    "op7_exact_tree_merge": exact_dedup.SQL,
    "op9_mix_prefix_sums": mixing.SQL,
    "op11_merkle_log": merkle.SQL,
    "op12_strassen_negatives": hard_negatives.SQL,
    "op13_license_automata": license_scan.SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
