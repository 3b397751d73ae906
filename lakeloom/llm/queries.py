"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from lakeloom.llm import bpe, chat, langid, linededup, mixing, quality, simhash, tokencount, topk, toxicity

QUERIES = {
    "op1_bpe": bpe.op1,
    "op2_toxicity": toxicity.op2,
    "op3_line_dedup": linededup.op3,
    "op4_token_counts": tokencount.op4,
    "op5_mixing": mixing.op5,
    "op6_language_id": langid.op6,
    "op7_quality_rules": quality.op7,
    "op8_topk": topk.op8,
    "op9_chat_formatting": chat.op9,
    "op10_simhash": simhash.op10,
}

ORACLES = {
    "op8_topk": topk.OP8_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
}
