"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from equigauge.llm import bpe, chat, dedup, mixing, neighbours, pii, quality, repair, search, syncmers, tokens, urls, weak

QUERIES = {
    "op1_quality_votes": quality.query,
    "op2_url_filter": urls.query,
    "op3_bpe_words": bpe.query,
    "op4_descent_graph": neighbours.query,
    "op5_bbit_minhash": dedup.query,
    "op6_chat_format": chat.query,
    "op7_pseudonyms": pii.query,
    "op8_source_mix": mixing.query,
    "op9_token_planes": tokens.query,
    "op10_syncmers": syncmers.query,
    "op11_suffix_dawg": repair.query,
    "op12_norm_buckets": search.query,
    "op13_weak_rules": weak.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_url_filter": urls.SQL,
    "op6_chat_format": chat.SQL,
    "op8_source_mix": mixing.SQL,
    "op11_suffix_dawg": repair.SQL,
    "op12_norm_buckets": search.SQL,
    "op13_weak_rules": weak.SQL,
}
