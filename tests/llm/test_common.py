"""The rows that remain, against a dictionary of keys."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import common as K

SCHEMA = "doc_id long, text string, key string, met string, part long, stays string, gone_id long"


def rows():
    draw = random.Random(3)
    some = [(draw.choice([None, *range(40)]), draw.choice([None, "", "a", "b", "c"]), "x", None, 1, "y", 2) for _ in range(300)]
    return some + [(None, None, None, None, None, None, None)] * 50


@pytest.mark.parametrize("most", [K.BITMAP, K.SIEVE])
@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_one_row_of_each_key_that_stays(spark, share, most):
    docs = spark.createDataFrame(rows(), SCHEMA)
    keys = docs.select(*K.row_key())
    draw = random.Random(7)
    known = collections.Counter((r[0], r[1] or "") for r in rows())
    kept = {k for k in sorted(known, key=repr) if draw.random() < share}
    chosen = spark.createDataFrame(list(kept), "doc_id long, text string").select(*K.row_key())
    found = K.remaining(docs, keys, chosen, most)
    assert found.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text or "") for r in found.collect()) == collections.Counter(kept)


def test_a_sieve_with_every_bit_set_loses_nothing(spark):
    """Far more keys go than the sieve has bits, so that all rows are judged by their key."""
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    keys = docs.select(*K.row_key())
    found = K.remaining(docs, keys, keys.where("doc_id % 100 = 0"), K.BITMAP)
    got = found.agg(F.count("*"), F.sum("doc_id"), F.max(F.col("doc_id") % 100)).first()
    assert tuple(got) == (3000, sum(range(0, 300_000, 100)), 0)


def test_rows_whose_bit_is_clear_are_not_shuffled(spark):
    docs = K.materialize(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")), "docs")
    keys = K.stored(docs.select(*K.row_key()), "keys")
    found = K.remaining(docs, keys, keys.where("doc_id <> 7"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    passed = plan[: plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in passed and "text" in passed and "hashpartitioning" not in passed
    assert found.count() == 4999


def test_a_row_that_stands_very_often_is_reduced_before_it_is_shuffled(spark):
    some = F.when(F.col("id") % 3 > 0, F.col("id"))
    docs = K.materialize(spark.range(90_000).select(some.alias("doc_id"), some.cast("string").alias("text")), "docs")
    keys = K.stored(docs.select(*K.row_key()), "keys")
    for gone in ("doc_id = 1", "doc_id is null"):
        found = K.remaining(docs, keys, keys.distinct().where(f"not coalesce({gone}, false)"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("partial_first(row") == 1
        assert found.count() == 60_000 and found.where(gone).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    keys = docs.select(*K.row_key())
    assert K.remaining(docs, keys, keys).count() == 0
