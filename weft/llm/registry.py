"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from weft.llm import chat, decontamination, exact_dedup, near_dedup, packing, repeats, secrets, tokens, toxicity, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_warc_revisits": warc.op3_warc_revisits,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_token_files": tokens.op5_token_files,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat.op7_chat_format,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_repeat_removal": repeats.op9_repeat_removal,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
SQL = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op2_decontamination": decontamination.OP2_SQL,
    "op3_warc_revisits": warc.OP3_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
