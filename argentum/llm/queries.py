"""Queries of this subpackage, by the names under which the entry point registers them."""

from __future__ import annotations

from .codec import op3_bpe_round_trip
from .near_dup import op4_near_duplicates
from .oracle import NEAR_DUPLICATES_SQL, quality_rules_sql
from .packing import op6_best_fit_packing
from .quality_crf import op8_quality_crf
from .quality_rules import op5_quality_rules
from .token_counts import op1_token_counts
from .token_store import op2_token_store
from .top_k import TOP_K_SQL, op10_exact_top_k
from .url_filter import op7_url_filter
from .warc import WARC_SQL, op9_warc_round_trip

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_token_store": op2_token_store,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7_url_filter,
    "op8_quality_crf": op8_quality_crf,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_exact_top_k": op10_exact_top_k,
}

#: DuckDB SQL where it can express an operator.
ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": NEAR_DUPLICATES_SQL,
    "op5_quality_rules": quality_rules_sql(),
    "op9_warc_round_trip": WARC_SQL,
    "op10_exact_top_k": TOP_K_SQL,
}
