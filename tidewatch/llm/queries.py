"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidewatch.llm import bpe, chat, exact_dedup, line_dedup, mixing, neighbours, prefix_trie, quality, sharding, simhash, suffix_dedup, token_files, vector_codes

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_bpe": bpe.op3_bpe,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_sharding": sharding.op10_sharding,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_nearest": neighbours.op13_nearest,
}

ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op6_chat_formatting": chat.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
