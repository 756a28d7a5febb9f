"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quire.llm import (
    bit_sliced, exact_dedup, lexical_search, line_dedup, mixing, near_dedup, packing, pii, quality_ledger, secrets, token_counts, warc,
    whitening)

QUERIES = {
    "op1_line_dedup": line_dedup.q_line_dedup,
    "op2_packing": packing.q_packing,
    "op3_near_dedup": near_dedup.q_near_dedup,
    "op4_mixing": mixing.q_mixing,
    "op5_exact_dedup": exact_dedup.q_exact_dedup,
    "op6_quality_rules": quality_ledger.q_quality_rules,
    "op7_pii": pii.q_pii,
    "op8_warc": warc.q_warc,
    "op9_secret_scan": secrets.q_secret_scan,
    "op10_token_counts": token_counts.q_token_counts,
    "op11_vector_search": bit_sliced.q_vector_search,
    "op12_whitening": whitening.q_whitening,
    "op13_lexical_search": lexical_search.q_lexical_search,
}

ORACLE = {
    "op4_mixing": mixing.SQL_MIXING,
    "op5_exact_dedup": exact_dedup.SQL_EXACT_DEDUP,
    "op6_quality_rules": quality_ledger.SQL_QUALITY_RULES,
    "op8_warc": warc.SQL_WARC,
    "op11_vector_search": bit_sliced.SQL_VECTOR_SEARCH,
    "op13_lexical_search": lexical_search.SQL_LEXICAL_SEARCH,
}
