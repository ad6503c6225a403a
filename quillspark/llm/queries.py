"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from quillspark.llm import decontaminate, merkle, mixing, passages, quality, repeats, secrets, simhash, token_count, toxicity

QUERIES = {
    "op1_passages": passages.op1_passages,
    "op2_fingerprints": merkle.op2_fingerprints,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_repeats": repeats.op6_repeats,
    "op7_secrets": secrets.op7_secrets,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_counts": token_count.op10_token_counts,
}

SQL = {
    "op2_fingerprints": merkle.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
