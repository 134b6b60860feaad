"""Exact groups against a dictionary of normalised texts."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from kinfold.llm import exact_dedup as E

ROWS = [
    (5, "a  b", "x"),
    (3, "a b", "x"),
    (9, "a\tb", None),
    (None, "a b", "y"),
    (4, "", "x"),
    (7, None, "x"),
    (8, "é b", "x"),
    (8, "é b", "x"),
    (8, "other", "x"),
    (None, "alone", "x"),
    (None, "alone", "x"),
    (11, " a b", "x"),
    (12, "long " * 50_000, "x"),
    (13, "long  " * 50_000, "x"),
    (14, "a b", "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def brute(rows):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, digest, done = min(known, default=None), hashlib.sha256(text.encode()).hexdigest(), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not done, digest))
            done = done or i == keep
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_groups_equal_brute_force(spark):
    assert order(E.exact_groups(frame(spark, ROWS)).collect()) == order(brute(ROWS))


def test_one_row_stays_of_each_group(spark):
    docs = frame(spark, ROWS).withColumn("sha", F.lit("clash"))
    found = E.deduplicated(docs)
    assert found.columns == docs.columns
    texts = [re.sub(r"[ \t-\r]+", " ", r["text"] or "") for r in found.collect()]
    assert sorted(texts) == sorted({re.sub(r"[ \t-\r]+", " ", t or "") for _, t, _ in ROWS})
    assert {r["doc_id"] for r in found.collect()} == {k for _, k, _, kept, _ in brute(ROWS) if kept}


def test_empty_table(spark):
    assert E.exact_groups(frame(spark, [])).count() == 0
    assert E.deduplicated(frame(spark, [])).count() == 0


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (8, 2), (9, 3), (4096, 16)])
def test_rounds_do_not_change_the_result(spark, runs, fan_in):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    rows = E._digests(docs)
    merged = E.merge_runs(rows, runs, fan_in)
    got = {r["keep_id"]: r["group_size"] for r in merged.collect()}
    assert got == {i: 43 if i < 6 else 42 for i in range(7)}
    of_row = {r["row"]: r["doc_id"] for r in rows.collect()}
    assert all(of_row[r["keep_row"]] == r["keep_id"] for r in merged.collect())
    plan = merged._jdf.queryExecution().executedPlan().toString()
    rounds = math.ceil(round(math.log(runs, fan_in), 9))
    assert plan.count("Window") >= rounds and "Generate" not in plan


def test_a_row_that_stands_very_often(spark):
    """No list grows with the number of times that a row is repeated."""
    docs = spark.range(400_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("text")
    )
    found = E.exact_groups(docs).groupBy("text_sha256").agg(
        F.sum(F.col("kept").cast("int")).alias("kept"), F.max("group_size").alias("size"), F.count("*").alias("n"),
        F.min("keep_id").alias("keep_id"),
    )
    got = sorted((r["kept"], r["size"], r["n"], r["keep_id"]) for r in found.collect())
    nulls = sum(i % 3 == 0 for i in range(400_000))
    assert got == [(1, nulls, nulls, None), (1, 400_000 - nulls, 400_000 - nulls, 1)]
    assert E.deduplicated(docs).count() == 2
