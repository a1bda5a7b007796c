"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

from . import decontaminate, langid, lm, neardup, packing, quality, repeats, secrets, tokenids, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_language_id": langid.op2_language_id,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_repeated_bytes": repeats.op6_repeats,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_warc": warc.op8_warc,
    "op9_token_files": tokenids.op9_token_files,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLE_SQL = {"op1_secret_scan": secrets.oracle_sql(), "op6_repeated_bytes": repeats.ORACLE_SQL, "op7_near_duplicates": neardup.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL}
