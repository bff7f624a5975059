"""Queries of the subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import byte_gru, chat_format, chunk_dedup, cover_tree, jaccard_join, line_crf, line_dedup, merkle_manifest, packing, pieces, quality_rules, source_divergence, token_shards

QUERIES = {
    "op1_line_crf": line_crf.query,
    "op10_chunk_dedup": chunk_dedup.query,
    "op11_source_divergence": source_divergence.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_line_dedup": line_dedup.query,
    "op2_chat_format": chat_format.query,
    "op3_cutting_stock": packing.query,
    "op4_token_shards": token_shards.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_byte_gru": byte_gru.query,
    "op7_quality_rules": quality_rules.query,
    "op8_cover_tree": cover_tree.query,
    "op9_sentencepiece": pieces.query,
}

ORACLE_SQL = {
    "op11_source_divergence": source_divergence.SQL,
    "op12_merkle_manifest": merkle_manifest.SQL,
    "op13_line_dedup": line_dedup.SQL,
    "op2_chat_format": chat_format.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_cover_tree": cover_tree.SQL,
}
