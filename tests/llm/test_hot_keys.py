"""Joins at a key with a third of all rows are split, seen in the plans that ran."""

import contextlib

import pytest
from pyspark.sql import functions as F

from kinfold.llm import components, secrets, simhash

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def low(spark):
    """A session that calls small partitions skewed."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextlib.contextmanager
def plans(module, monkeypatch):
    """The plans, as they ran, of the tables that the module stores, by tag."""
    real, seen = module.stored, {}

    def spy(df, tag, *rest):
        df.collect()
        seen[tag] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, tag, *rest)

    monkeypatch.setattr(module, "stored", spy)
    yield seen


def test_the_star_of_a_hub(low):
    ids = low.range(40_000, numPartitions=16)
    pairs = ids.select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("u"), (F.col("id") + 1).alias("v"))
    stars = components._stars(pairs)
    assert len(stars.collect()) == 40_000
    assert "skew=true" in stars._jdf.queryExecution().executedPlan().toString()


def test_a_secret_of_a_third_of_all_rows(low, monkeypatch):
    value = F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise(F.col("id").cast("string"))
    text = F.concat(F.lit("token = "), F.substring(F.sha2(value, 256), 1, 40))
    docs = low.range(12_000, numPartitions=16).select(F.col("id").alias("doc_id"), text.alias("text"))
    with plans(secrets, monkeypatch) as seen:
        found = secrets.secret_spans(docs, F.col("doc_id") % 100, F.col("doc_id") % 10)
        assert found.agg(F.sum("n_copied")).first()[0] == 8000
    assert "skew=true" in seen["secret-verdicts"]


def test_a_fingerprint_of_a_third_of_all_rows(low):
    words = F.when(F.col("id") % 3 == 0, F.lit("a b c d")).otherwise(F.concat(F.lit("w "), (F.col("id") % 500).cast("string")))
    docs = low.range(60_000, numPartitions=8).select(F.col("id").alias("doc_id"), words.alias("text"))
    found = simhash.near_duplicates(docs)
    hot = [r for r in found.collect() if r.doc_id % 3 == 0]
    assert len(hot) == 20_000 and {r.component_id for r in hot} == {0}
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
