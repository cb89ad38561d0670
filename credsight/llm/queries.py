"""Named queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from credsight.llm import (
    op1_bpe,
    op2_decontaminate,
    op3_quality,
    op4_jaccard,
    op5_tokens,
    op6_toxicity,
    op7_lines,
    op8_langid,
    op9_chat,
    op10_fingerprint,
    op11_bayes,
    op12_align,
    op13_rank,
)

QUERIES = {
    "op1_bpe": op1_bpe.op1_bpe,
    "op2_decontaminate": op2_decontaminate.op2_decontaminate,
    "op3_quality": op3_quality.op3_quality,
    "op4_jaccard": op4_jaccard.op4_jaccard,
    "op5_tokens": op5_tokens.op5_tokens,
    "op6_toxicity": op6_toxicity.op6_toxicity,
    "op7_lines": op7_lines.op7_lines,
    "op8_langid": op8_langid.op8_langid,
    "op9_chat": op9_chat.op9_chat,
    "op10_fingerprint": op10_fingerprint.op10_fingerprint,
    "op11_bayes": op11_bayes.op11_bayes,
    "op12_align": op12_align.op12_align,
    "op13_rank": op13_rank.op13_rank,
}

ORACLES = {
    "op2_decontaminate": op2_decontaminate.ORACLE,
    "op7_lines": op7_lines.ORACLE,
    "op9_chat": op9_chat.ORACLE,
    "op11_bayes": op11_bayes.ORACLE,
    "op13_rank": op13_rank.ORACLE,
}
