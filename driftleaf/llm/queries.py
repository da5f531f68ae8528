"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from driftleaf.llm import (
    chat, divergence, exact_search, language, licences, mixing, near_dedup, nearest, packing, prefix_trie, sharding, token_counts, warc,
)


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over a whole table."""
    return lambda spark, sf: operator(spark.read.parquet(f"{sf}/{name}.parquet"))


QUERIES = {
    "op1_chat": over("conversations", chat.op1_chat),
    "op2_packing": over("documents", packing.op2_packing),
    "op3_exact_search": over("embeddings", exact_search.op3_exact_search),
    "op4_mixing": over("documents", mixing.op4_mixing),
    "op5_revisits": over("pages", warc.op5_revisits),
    "op6_language": over("documents", language.op6_language),
    "op7_nearest": over("embeddings", nearest.op7_nearest),
    "op8_near_dedup": over("documents", near_dedup.op8_near_dedup),
    "op9_sharding": over("documents", sharding.op9_sharding),
    "op10_licences": over("documents", licences.op10_licences),
    "op11_source_divergence": over("documents", divergence.op11_source_divergence),
    "op12_token_counts": over("documents", token_counts.op12_token_counts),
    "op13_prefix_trie": over("conversations", prefix_trie.op13_prefix_trie),
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_chat": chat.SQL,
    "op3_exact_search": exact_search.SQL,
    "op4_mixing": mixing.SQL,
    "op5_revisits": warc.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
