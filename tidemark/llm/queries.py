"""The queries of this subpackage, by name."""

from __future__ import annotations

from . import chat, fingerprints, merkle, minhash, mixing, neighbours, packing, quality, sql, substring, suffix, token_files, toxicity, trie

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_substring_dedup": substring.op2,
    "op3_nearest": neighbours.op3,
    "op4_chat_format": chat.op4,
    "op5_pack": packing.op5,
    "op6_suffix_dedup": suffix.op6,
    "op7_mixing": mixing.op7,
    "op8_fingerprints": fingerprints.op8,
    "op9_token_files": token_files.op9,
    "op10_minhash": minhash.op10,
    "op11_merkle": merkle.op11,
    "op12_quality": quality.op12,
    "op13_trie": trie.op13,
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": sql.OP2_SQL,
    "op3_nearest": neighbours.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op6_suffix_dedup": sql.OP6_SQL,
    "op7_mixing": sql.OP7_SQL,
    "op10_minhash": sql.OP10_SQL,
    "op11_merkle": sql.OP11_SQL,
    "op13_trie": sql.OP13_SQL,
}
