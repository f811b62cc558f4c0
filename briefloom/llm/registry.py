"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from briefloom.llm import line_dedup, merkle
from briefloom.llm.decontamination import decontamination_query
from briefloom.llm.jaccard_join import jaccard_query
from briefloom.llm.language_id import language_id_query
from briefloom.llm.lm_scoring import lm_query
from briefloom.llm.sentencepiece_codec import encode_query
from briefloom.llm.simhash import simhash_query
from briefloom.llm.substring_dedup import substring_query
from briefloom.llm.token_counts import token_count_query
from briefloom.llm.top_k import top_k_query
from briefloom.llm.url_filter import url_filter_query
from briefloom.llm.vector_codes import VECTOR_CODES_SQL, vector_codes_query

#: The URL rules of the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, from the folder in BRIEFLOOM_TOKENIZERS or else the installed package."""
    if folder := os.environ.get("BRIEFLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": lambda spark, d: token_count_query(spark, d, tokenizer_file("word_bpe_49k.json")),
        "op2_decontamination": decontamination_query,
        "op3_language_id": language_id_query,
        "op4_substring_dedup": substring_query,
        "op5_url_filter": lambda spark, d: url_filter_query(spark, d, URL_RULES),
        "op6_sentencepiece": lambda spark, d: encode_query(spark, d, tokenizer_file("piece_bpe_32k.model")),
        "op7_lm_scoring": lm_query,
        "op8_top_k": top_k_query,
        "op9_jaccard_join": jaccard_query,
        "op10_line_dedup": line_dedup.line_dedup_query,
        "op11_merkle_manifest": merkle.manifest_query,
        "op12_simhash": simhash_query,
        "op13_vector_codes": vector_codes_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": line_dedup.LINE_DEDUP_SQL, "op11_merkle_manifest": merkle.MANIFEST_SQL, "op13_vector_codes": VECTOR_CODES_SQL}
