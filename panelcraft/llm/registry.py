"""Registered training-data queries: one ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .chat import op9_chat_tree
from .collocations import op12_collocations
from .decontaminate import op3_decontaminate
from .fingerprints import op6_fingerprints
from .hard_negatives import op11_hard_negatives
from .language_id import op13_language_id
from .licenses import op8_licenses
from .near_dedup import op1_dart_minhash
from .oracle import ORACLE
from .packing import op2_pack
from .pii import op5_personal_data
from .pseudo_likelihood import op4_pseudo_likelihood
from .shipping import ship_package
from .token_counts import op7_token_counts
from .toxicity import op10_toxicity

QUERIES = [
    op1_dart_minhash,
    op2_pack,
    op3_decontaminate,
    op4_pseudo_likelihood,
    op5_personal_data,
    op6_fingerprints,
    op7_token_counts,
    op8_licenses,
    op9_chat_tree,
    op10_toxicity,
    op11_hard_negatives,
    op12_collocations,
    op13_language_id,
]


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
