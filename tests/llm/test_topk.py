"""Exact top-k against all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import grid as G
from kinfold.llm import topk as T


def brute(rows, every, k):
    """Every row against every other row, as the contract has it: a row is what stands in the table."""
    vectors = []
    for n, (i, x) in enumerate(rows):
        if i is not None and x and not any(v is None or not math.isfinite(v) for v in x):
            vectors.append((n, i, [math.floor(64 * float(c)) for c in x]))
    out = []
    for n, q, a in vectors:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in vectors if m != n)
            out.extend((q, place + 1, i, -s) for place, (s, i) in enumerate(scores[:k]))
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.withColumn("score", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("row", F.lit(None))
    return sorted(map(tuple, T.top_inner_products(frame, **options).collect()))


@pytest.mark.parametrize("parts,query_rows", [(1, 1), (4, 3), (3, 1000)])
def test_equals_brute_force(spark, parts, query_rows):
    draw = random.Random(parts)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(10)]) for i in range(150)]
    rows += [(200 + i, [0.5, -0.25] * 5) for i in range(60)]  # ties
    rows += [(7, None), (8, [None, 1.0]), (9, [float("nan")] * 10), (300, [float("inf")] * 10), (None, [1.0] * 10)]
    rows += [(3, rows[3][1]), (310, [0.0] * 10), (320, [-1.0] * 12), (-20, [1.0, 2.0, 3.0]), (321, [])]
    rows += [(40, rows[40][1]), (41, [0.9] * 10)]  # a query twice, and an id with two vectors
    got = run(spark, rows, every=20, k=5, parts=parts, query_rows=query_rows)
    assert got == brute(rows, 20, 5)


def test_rows_that_share_an_id_are_candidates_of_their_own(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.9, 0.0]), (1, [0.2, 0.6]), (2, [0.1, 0.1])]
    assert run(spark, rows) == [(0, 1, 1, 64 * 57), (0, 2, 1, 12 * 64 + 38 * 32), (0, 3, 2, 6 * 64 + 6 * 32)]


def test_large_components_fewer_candidates_and_empty(spark):
    rows = [(0, [3e6, -2e6]), (20, [1e6, 5.0]), (1, [-1e6, 1e6])]
    assert run(spark, rows) == brute(rows, 20, 20)
    assert run(spark, [(1, [1.0])]) == [] and run(spark, [(20, [1.0])]) == [] and run(spark, []) == []


def test_grid_moves_few_copies():
    for n_queries, n_rows, tasks in [(5, 100, 8), (1000, 50_000, 200), (2 * 10**7, 10**9, 4000), (0, 0, 8)]:
        q, r = G.shape(n_queries, n_rows, tasks)
        assert q >= 1 and r >= 1 and n_queries / q <= G.QUERY_ROWS
        if n_rows >= tasks * 512:
            assert q * r >= tasks
    assert G.shape(1000, 50_000, 90)[0] == 1  # no row is copied where all queries fit a task
