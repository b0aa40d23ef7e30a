"""One query for each training-data operator, over its whole table. On a cluster whose executors don't have this package,
call session.attach(spark) first, as the entry points do."""

from __future__ import annotations

from . import byte_bpe, cap_filters, class_lm, language_id, line_dedup, packing, quality_model, quality_rules, simhash, spelling, token_files, url_reputation, whitening

QUERIES = {
    "op1_class_lm": class_lm.query,
    "op2_cap_filters": cap_filters.query,
    "op3_quality_rules": quality_rules.query,
    "op4_line_dedup": line_dedup.query,
    "op5_token_files": token_files.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_quality_classifier": quality_model.query,
    "op8_simhash": simhash.query,
    "op9_url_reputation": url_reputation.query,
    "op10_packing": packing.query,
    "op11_language_id": language_id.query,
    "op12_whitening": whitening.query,
    "op13_spelling": spelling.query,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op9_url_reputation": url_reputation.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
