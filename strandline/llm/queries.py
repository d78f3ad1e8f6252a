"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, html, images, jaccard, katz, langid, mixing, quality, repair, runs, substrings, tokens

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_quality_rank": quality.op3_quality_rank,
    "op4_language_id": langid.op4_language_id,
    "op5_main_text": html.op5_main_text,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_image_copies": images.op7_image_copies,
    "op8_chat_format": chat.op8_chat_format,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_katz_score": katz.op10_katz_score,
    "op11_token_shards": tokens.op11_token_shards,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_periodic_runs": runs.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op2_ngram_jaccard": jaccard.OP2_SQL,
    "op5_main_text": html.OP5_SQL,
    "op6_source_mix": mixing.OP6_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
}
