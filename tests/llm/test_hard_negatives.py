"""Hard negatives against a search of every window."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinfold.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives, take):
    known = []
    for n, (i, x, label) in enumerate(rows):
        if None not in (i, label) and x and not any(v is None or not math.isfinite(v) for v in x):
            known.append((n, i, label, [math.floor(256 * float(c)) for c in x]))
    out = []
    for n, a, label, v in known:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for m, i, other, w in known if m != n)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            low, high = Fraction(-p, 2), Fraction(-p * 95, 100)
            window = [(i, -s) for s, i, other in scored if other != label and low <= -s <= high]
            out.extend((a, positive, k + 1, i, -p, s) for k, (i, s) in enumerate(window[:take]))
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    frame = frame.withColumn("score", F.lit("clash")).withColumn("info", F.lit(1)).withColumn("row", F.lit(None))
    return sorted(map(tuple, H.hard_negatives(frame, **options).collect()))


@pytest.mark.parametrize("seed,positives,take", [(1, 5, 3), (2, 1, 1), (3, 8, 2)])
def test_equals_brute_force(spark, seed, positives, take):
    draw = random.Random(seed)
    rows = []
    for i in range(240):
        label = 0 if draw.random() < 0.4 else draw.randrange(1, 5)  # a label with many rows
        rows.append((i, [draw.gauss(0.25, 0.3) for _ in range(6)], label))
    rows += [(300 + i, [0.5, 0.25] * 3, i % 3) for i in range(60)]  # ties in both roles
    rows += [(20, rows[20][1], rows[20][2]), (31, [0.4] * 6, 2), (31, [0.4] * 6, 2)]  # repeated rows and ids
    rows += [(400, None, 1), (420, [None, 1.0], 1), (440, [float("nan")] * 6, 1), (460, [0.3] * 6, None)]
    rows += [(None, [0.3] * 6, 1), (480, [0.0] * 6, 1), (500, [-0.5] * 6, 2), (520, [0.7, 0.7], 3), (540, [], 0)]
    got = run(spark, rows, every=20, positives=positives, take=take)
    assert got == brute(rows, 20, positives, take)
    assert got


def test_limits_of_the_windows_count(spark):
    # The anchor's products with [k / 256] are k * 256: the positive has 100 * 256.
    one = lambda k: [k / 256]
    rows = [(0, one(256), 0), (1, one(100), 0), (2, one(95), 1), (3, one(96), 1), (4, one(50), 2), (5, one(49), 2)]
    got = run(spark, rows)
    assert got == [(0, 1, 1, 2, 25600, 24320), (0, 1, 2, 4, 25600, 12800)]


def test_nothing_to_mine(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0], 1)]) == []
    assert run(spark, [(50, [1.0], 1), (1, [1.0], 1)]) == []
    # Below a positive of a negative score lies no window.
    assert run(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.7], 1)]) == []


def test_labels_move_first(spark):
    frame = spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None), (0, [1.0], 3)], SCHEMA)
    assert [r["label"] for r in H.relabelled(frame).orderBy("vec_id").collect()] == [4, 0, 9, None]
