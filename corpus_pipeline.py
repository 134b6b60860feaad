"""The corpus pipeline: quality, exact and near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and reads it again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import exact_dedup, mixing, packing, quality, simhash
from kinfold.llm.common import materialize, table
from kinfold.session import discard, scratch

# Compression, SimHash and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier takes, learned from ``labels`` and these rows.

    Null texts are scored as empty, repeated rows alike; rows with null or
    unlabelled ids are scored like others and not learned from. Without labels
    of both classes see ``quality.quality_model``. An empty table stays empty.
    """
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts.

    The row of the least id stays, null ids last, and one of those that repeat
    it; null and empty texts are equal. An empty table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal fingerprints.

    The row of the least id stays, null ids last; of rows that share it the one
    with the least hash of its text, and of rows that repeat both, one. Texts
    without words, null ones too, have equal fingerprints. An empty table stays empty.
    """
    return simhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, repeated rows equally often.

    A null source is a source of its own; null texts have no words; a source
    without any words keeps its rows as they are. An empty table stays empty.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their sequences.

    A null text is an empty one, which is the end token alone; repeated rows are
    packed once each, null ids like others. An empty table gives an empty result.
    """
    return packing.with_digest(packing.packed(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # a stage's own tables go once its result is written
            made = keep(materialize(stage(spark, docs, sf_dir), name))
        discard(docs)  # what the stage before has written
        docs = made
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracles() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
