"""Registered queries of the corpus operators. Those without SQL text are tested against brute force."""

from __future__ import annotations

from . import alignment, jaccard, language, pieces, quality, repair, secrets, separators, substring, templates, vectors, whitening, wrappers

QUERIES = {
    "op1_template_leaks": templates.query,
    "op2_dimension_scan": vectors.query,
    "op3_repair_tokens": repair.query,
    "op4_piece_agenda": pieces.query,
    "op5_separator_scan": separators.query,
    "op8_chosen_path_join": jaccard.query,
    "op9_quality": quality.query,
    "op10_language": language.query,
    "op6_page_wrappers": wrappers.query,
    "op7_substring_dedup": substring.query,
    "op11_whitening": whitening.query,
    "op12_token_alignment": alignment.query,
    "op13_credential_links": secrets.query,
}

ORACLE_SQL: dict[str, str] = {"op1_template_leaks": templates.oracle(), "op13_credential_links": secrets.oracle()}
