"""Queries of this package by name, and the SQL that checks them."""

from __future__ import annotations

from evidora.llm.decontamination import OP3_SQL, op3_benchmark_overlaps
from evidora.llm.embedding_dedup import OP2_SQL, op2_embedding_near_dedup
from evidora.llm.hosts import OP8_SQL, op8_url_reputation
from evidora.llm.langid import op6_language_id
from evidora.llm.lexical import OP12_SQL, op12_ranked_search
from evidora.llm.merkle import OP11_SQL, op11_merkle_manifest
from evidora.llm.mixing import OP5_SQL, op5_curriculum_mix
from evidora.llm.mixing_lm import op7_mixing_lm
from evidora.llm.secret_scan import op10_secret_scan
from evidora.llm.simhash import op4_simhash_near_dedup
from evidora.llm.substring import OP1_SQL, op1_substring_dedup
from evidora.llm.suffixes import OP13_SQL, op13_suffix_dedup
from evidora.llm.tokens import op9_token_counts

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_benchmark_overlaps": op3_benchmark_overlaps,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_curriculum_mix": op5_curriculum_mix,
    "op6_language_id": op6_language_id,
    "op7_mixing_lm": op7_mixing_lm,
    "op8_url_reputation": op8_url_reputation,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op2_embedding_near_dedup": OP2_SQL,
    "op3_benchmark_overlaps": OP3_SQL,
    "op5_curriculum_mix": OP5_SQL,
    "op8_url_reputation": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
