"""The subpackage's registered queries, each over its whole tables, and the SQL that states their results."""

from __future__ import annotations

from . import decontaminate, jaccard, language, lines, packing, pii, quality, secrets, tokens, warc

QUERIES = {
    "op1_length_buckets": packing.op1,
    "op2_warc_transactions": warc.op2,
    "op3_jaccard_join": jaccard.op3,
    "op4_pii_pseudonyms": pii.op4,
    "op5_quality_lines": quality.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_language_id": language.op7,
    "op8_secret_scan": secrets.op8,
    "op9_line_dedup": lines.op9,
    "op10_token_rollups": tokens.op10,
}

SQL = {
    "op2_warc_transactions": warc.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op10_token_rollups": tokens.OP10_SQL,
}
