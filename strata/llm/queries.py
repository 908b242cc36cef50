"""Registered queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    align,
    decontaminate,
    exact,
    language,
    licenses,
    minhash,
    packing,
    pivots,
    rlz,
    suffixes,
    toxicity,
    trie,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": rlz.query,
    "op2_language_id": language.query,
    "op3_license_scan": licenses.query,
    "op4_token_matrices": packing.query_matrices,
    "op5_exact_dedup": exact.query,
    "op6_toxicity": toxicity.query,
    "op7_best_fit_packing": packing.query,
    "op8_decontamination": decontaminate.query,
    "op9_suffix_dedup": suffixes.query,
    "op10_near_dedup": minhash.query,
    "op11_conversation_trie": trie.query,
    "op12_token_alignment": align.query,
    "op13_embedding_dedup": pivots.query,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": rlz.ORACLE,
    "op5_exact_dedup": exact.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op10_near_dedup": minhash.ORACLE,
    "op11_conversation_trie": trie.ORACLE,
    "op13_embedding_dedup": pivots.ORACLE,
}
