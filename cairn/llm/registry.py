"""The queries of this subpackage and the SQL that checks them, by name."""

from cairn.llm import bpe, chat, conversation_repair, embedding_dedup, exact_dedup, line_dedup, minhash, mixing, substring_dedup, topk, toxicity, url_filter, whitening

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_topk": topk.op4_topk,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_chat": chat.op8_chat,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}
SQL = {
    "op1_minhash": minhash.SQL,
    "op4_topk": topk.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op8_chat": chat.SQL,
    "op9_url_filter": url_filter.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
