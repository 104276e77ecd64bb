"""Registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from streamsift.llm.audit import OP11_SQL, op11_filter_audit
from streamsift.llm.decontam import op8_decontamination
from streamsift.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from streamsift.llm.langid import op10_language_id
from streamsift.llm.lm import op5_lm_scoring
from streamsift.llm.minhash import op3_minhash
from streamsift.llm.mixing import OP12_SQL, op12_mixing
from streamsift.llm.pieces import op4_sentencepiece
from streamsift.llm.sharding import op6_sharding
from streamsift.llm.spelling import op13_spelling_variants
from streamsift.llm.token_files import op9_token_files
from streamsift.llm.toxicity import op1_toxicity
from streamsift.llm.warc import op7_warc

LLM_QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_minhash": op3_minhash,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_mixing": op12_mixing,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Operators whose rows SQL can express; the others are tested against
#: brute-force versions, round trips or held-out accuracy in tests/llm.
LLM_SQL = {"op2_exact_dedup": OP2_SQL, "op11_filter_audit": OP11_SQL, "op12_mixing": OP12_SQL}
