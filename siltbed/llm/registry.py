"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from siltbed.llm import bpe, langid, minhash, mixing, ppm, quality, repair, token_counts, toxicity, webp

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality": quality.query,
    "op3_bpe": bpe.query,
    "op4_langid": langid.query,
    "op5_toxicity": toxicity.query,
    "op6_repair": repair.query,
    "op7_ppm": ppm.query,
    "op8_minhash": minhash.query,
    "op9_token_counts": token_counts.query,
    "op10_webp": webp.query,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_quality": quality.ORACLE_SQL,
    "op8_minhash": minhash.ORACLE_SQL,
}
