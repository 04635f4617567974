"""Registered queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, decontaminate, licenses, quality, secrets, simhash, suffix_tree, topk, toxicity

QUERIES: dict = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_bpe": bpe.op2_bpe,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lm_score": suffix_tree.op6_lm_score,
    "op7_chat_format": chat.op7_chat_format,
    "op8_simhash": simhash.op8_simhash,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_secret_scan": secrets.op10_secret_scan,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op1_exact_topk": topk.OP1_SQL, "op7_chat_format": chat.OP7_SQL, "op9_license_scan": licenses.OP9_SQL}
