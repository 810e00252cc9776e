"""Registered queries of the training-data operators and their SQL."""
from cuelake.llm import bpe, cover_tree, line_dedup, minhash, mixing, pii, prefix_trie, quality, substring_dedup, token_output, topk_search, warc, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_token_output": token_output.op5_token_output,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_warc": warc.op7_warc,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_pii": pii.op9_pii,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_embedding_near_dedup": cover_tree.op11_embedding_near_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_topk_search": topk_search.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op7_warc": warc.ORACLE,
    "op11_embedding_near_dedup": cover_tree.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
