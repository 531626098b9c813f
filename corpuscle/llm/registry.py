"""The queries of this subpackage, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpuscle.llm import langid, media, mixing, oracles, packing, pii, ppm, quality, repeats, simhash, tokens


def queries() -> dict:
    found = [quality.op1_quality_rules, repeats.op2_repeated_windows, pii.op3_pii, tokens.op4_token_counts, mixing.op5_mixing, ppm.op6_lm_scores, media.op7_media_columns, langid.op8_language_id, simhash.op9_simhash, packing.op10_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
