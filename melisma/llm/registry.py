"""The queries of this subpackage, one for each operator over its whole table."""

from __future__ import annotations

from melisma.llm import decontam, langid, lm, packing, passages, quality, secrets, simhash, suffix, urls

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_decontamination": decontam.op2,
    "op3_packing": packing.op3,
    "op4_passage_dedup": passages.op4,
    "op5_language_id": langid.op5,
    "op6_simhash": simhash.op6,
    "op7_lm_scoring": lm.op7,
    "op8_url_filters": urls.op8,
    "op9_quality_rules": quality.op9,
    "op10_suffix_dedup": suffix.op10,
}
ORACLES: dict[str, str] = {"op8_url_filters": urls.ORACLE, "op9_quality_rules": quality.ORACLE}
