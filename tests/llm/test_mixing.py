"""Targets and copies of the mix against the contract, step by step."""

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing as M


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight; cap; share the excess among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1000, "c": 5, None: 3},
        {"a": 0, "b": 10, "c": 10},
        {"Z": 10, "a": 1, "é": 7, "aa": 2, "b": 90, None: 1},
        {"only": 12},
        {"a": 0},
    ],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.source_targets(frame).collect()}
    want = slow_targets(sizes)
    assert got == pytest.approx(want)


def test_plan(spark):
    rows = [(i, " ".join(["w"] * (i % 13)), ("s1", "s2", None)[i % 3 if i % 2 else 0]) for i in range(400)]
    rows += [(None, None, "s1"), (7, "a b", "s1"), (7, "a b", "s1"), (500, "  x\ty", "s9"), (501, "q " * 100_000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("size", F.lit("clash")).withColumn("mix_whole", F.lit(1)).withColumn("a", F.lit(1))
    plan = [r.asDict() for r in M.mixing_plan(docs).collect()]
    assert len(plan) == len(rows)
    by_id = {r["doc_id"]: r for r in plan}
    assert by_id[500]["size"] == 3 and by_id[None]["size"] == 0 and by_id[501]["size"] == 100_000
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in plan)
    assert len({r["copies"] for r in plan if r["doc_id"] == 7 and r["size"] == 2}) == 1
    again = M.mixing_plan(docs.repartition(7)).collect()
    assert sorted(map(repr, (r.asDict() for r in again))) == sorted(map(repr, plan))
    copies = M.mixed(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r["copies"] for r in plan)


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 4 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = M.mixing_plan(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source")
    for r in sums.agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect():
        assert r["t"] == pytest.approx(r["w"], rel=0.01)


def test_rows_of_a_source_without_words_stay(spark):
    rows = [(1, "", "blank"), (2, " \t", "blank"), (3, "a b c", "words"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in M.mixing_plan(docs).collect()}
    assert [plan[i]["copies"] for i in (1, 2, 3, 4)] == [1, 1, 1, 1] and plan[1]["taken"] == plan[1]["target"] == 0
    assert sorted(r["doc_id"] for r in M.mixed(docs).collect()) == [1, 2, 3, 4]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixing_plan(none).count() == 0 and M.mixed(none).count() == 0
