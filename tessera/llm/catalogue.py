"""The subpackage's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import chat_format, language_id, line_dedup, merkle, mixing, nearest, ngram_join, packing, quality_classifier, quality_rules, token_automaton, token_files, turn_repair


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.query,
        "op2_best_fit_packing": packing.query,
        "op3_token_files": token_files.query,
        "op4_quality_classifier": quality_classifier.query,
        "op5_line_dedup": line_dedup.query,
        "op6_quality_rules": quality_rules.query,
        "op7_ngram_jaccard_join": ngram_join.query,
        "op8_chat_format": chat_format.query,
        "op9_nearest_neighbours": nearest.query,
        "op10_language_id": language_id.query,
        "op11_turn_repair": turn_repair.query,
        "op12_merkle_manifest": merkle.query,
        "op13_token_automaton": token_automaton.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op8_chat_format": chat_format.ORACLE_SQL,
        "op11_turn_repair": turn_repair.ORACLE_SQL,
        "op12_merkle_manifest": merkle.ORACLE_SQL,
    }
