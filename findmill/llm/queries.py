"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from findmill.llm import (
    anchor_simhash,
    arc_convert,
    bpe_codec,
    chat_repair,
    collocations,
    fertility,
    line_dedup,
    secret_worklist,
    spfhp,
    surrogates,
    threshold_topk,
    token_align,
    wrappers,
)

QUERIES = {
    "op1_bpe": bpe_codec.op1_bpe,
    "op2_chat": chat_repair.op2_chat,
    "op3_fertility": fertility.op3_fertility,
    "op4_warc": arc_convert.op4_warc,
    "op5_surrogates": surrogates.op5_surrogates,
    "op6_threshold": threshold_topk.op6_threshold,
    "op7_simhash": anchor_simhash.op7_simhash,
    "op8_spfhp": spfhp.op8_spfhp,
    "op9_wrappers": wrappers.op9_wrappers,
    "op10_secrets": secret_worklist.op10_secrets,
    "op11_alignment": token_align.op11_alignment,
    "op12_collocations": collocations.op12_collocations,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLE_SQL = {"op6_threshold": threshold_topk.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_line_dedup": line_dedup.ORACLE_SQL}
