"""The corpus operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import (
    conversation_trie,
    exact_dedup,
    hard_negatives,
    html_text,
    lattice,
    mixing,
    packing,
    quality,
    revisits,
    secrets,
    simhash,
    topk,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_topk": topk.op3_topk,
        "op4_revisits": revisits.op4_revisits,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality.op6_quality,
        "op7_mixing": mixing.op7_mixing,
        "op8_simhash": simhash.op8_simhash,
        "op9_packing": packing.op9_packing,
        "op10_html": html_text.op10_html,
        "op11_embeddings": lattice.op11_embeddings,
        "op12_conversations": conversation_trie.op12_conversations,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_secrets": secrets.ORACLE,
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op3_topk": topk.ORACLE,
        "op4_revisits": revisits.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op11_embeddings": lattice.ORACLE,
        "op12_conversations": conversation_trie.ORACLE,
        "op13_hard_negatives": hard_negatives.ORACLE,
    }
