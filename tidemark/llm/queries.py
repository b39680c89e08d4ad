"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import conversations, katz, langid, mixing, near_dup, packing, pii, quality, spelling, tiff, token_counts, vafile, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_katz_lm": katz.op4_katz_lm,
    "op5_warc": warc.op5_warc,
    "op6_media_tiff": tiff.op6_media_tiff,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_exact_top_k": vafile.op8_exact_top_k,
    "op9_near_dup": near_dup.op9_near_dup,
    "op10_packing": packing.op10_packing,
    "op11_spelling": spelling.op11_spelling,
    "op12_conversations": conversations.op12_conversations,
    "op13_langid": langid.op13_langid,
}

ORACLES: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op8_exact_top_k": vafile.ORACLE,
}
