"""Lattice hashing against all pairs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import lattice as L


def brute(rows, cosine=0.95):
    """Row number -> (links, component) by the definition."""
    units = []
    for _, x in rows:
        ok = x and not any(v is None or not math.isfinite(v) for v in x) and any(x)
        v = np.array(x, float) if ok else None
        if ok:
            v = v / np.abs(v).max()
        units.append(v / np.linalg.norm(v) if ok else None)
    links = {n: set() for n in range(len(rows))}
    for a, b in itertools.combinations(range(len(rows)), 2):
        if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]):
            if units[a] @ units[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    out, seen = [None] * len(rows), set()
    for n in links:
        if n in seen:
            continue
        front, part = [n], {n}
        while front:
            for m in links[front.pop()] - part:
                part.add(m)
                front.append(m)
        seen |= part
        ids = [rows[m][0] for m in part if rows[m][0] is not None]
        for m in part:
            out[m] = (rows[m][0], len(links[m]), min(ids) if ids else None)
    return sorted(out, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.withColumn("key", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("v", F.lit(None)).repartition(3)
    return sorted(map(tuple, L.near_vectors(frame, **options).collect()), key=str)


def planted(seed, groups, alone, dim=16):
    """Groups of near vectors with cosines around the threshold and above."""
    draw = np.random.default_rng(seed)
    out = []
    for size, noise in groups:
        centre = draw.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            out.append(centre + noise * draw.standard_normal(dim) / math.sqrt(dim))
    out += list(draw.standard_normal((alone, dim)))
    order = draw.permutation(len(out))
    return [(int(i), (out[i] * draw.uniform(0.1, 9)).tolist()) for i in order]


def test_decodes_to_the_nearest_lattice_point():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((300, 8)) * 2
    points = L.nearest_point(x)
    twice = np.rint(points * 2).astype(int)
    assert (twice == points * 2).all() and (twice.sum(1) % 4 == 0).all()
    assert all(len(set((row % 2).tolist())) == 1 for row in twice)  # all whole or all halves
    off = ((x - points) ** 2).sum(1)
    assert (off <= 1 + 1e-9).all()  # the covering radius of E8 is one
    assert len(L._MINIMAL) == 240 and np.allclose((L._MINIMAL**2).sum(1), 2)
    for v in L._MINIMAL:
        assert (((x - points - v) ** 2).sum(1) >= off - 1e-9).all()


@pytest.mark.parametrize("tile", [4096, 16])
def test_equals_all_pairs_where_hashing_finds_all(spark, tile):
    """With many probes every pair meets; each counts once, in whatever cells and tiles it meets."""
    rows = planted(1, [(120, 0.05), (40, 0.2), (3, 0.2), (2, 0.0)], 150)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1001, rows[0][1]), (5, rows[1][1])]  # equal vectors, repeated ids
    assert run(spark, rows, tables=4, probes=24, tile=tile) == brute(rows)


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = [(i, [0.5, 0.25] * 8) for i in range(200)] + [(500 + i, x) for i, x in planted(2, [(150, 0.08)], 100)]
    assert run(spark, rows, tables=4, probes=24, tile=32) == brute(rows)


@pytest.mark.parametrize("blocks", [None, 2, 3])
def test_recall_at_the_threshold(spark, blocks):
    """Pairs with cosines from 0.95 to 0.97 only, for the layouts of small and large tables."""
    draw = np.random.default_rng(3)
    rows, dim = [], 64
    for i in range(600):
        a = draw.standard_normal(dim)
        b = draw.standard_normal(dim)
        a, b = a / np.linalg.norm(a), b - (b @ a) / (a @ a) * a
        c = draw.uniform(0.951, 0.97)
        near = c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, near.tolist())]
    sizes = {None: 1, 2: L._FIRST * 2, 3: L._FIRST * L._SPARSITY * 2}
    tables, own, probes = L.layout(sizes[blocks])
    assert own == (blocks or 1)
    got = run(spark, rows, tables=tables, blocks=own, probes=probes)
    found = sum(n for _, n, _ in got)
    assert found >= 0.9 * 1200
    assert all(n <= 1 and component in (i, i - i % 2) for i, n, component in got)


def test_what_links_with_nothing(spark):
    rows = [
        (1, None), (2, []), (3, [0.0] * 4), (4, [None, 1.0, 1.0, 1.0]), (5, [float("nan")] * 4), (6, [float("inf")] * 4),
        (7, [1.0] * 4), (8, [1.0] * 5), (9, [1e200] * 4), (10, [1e-200, 1e-200, 1e-200, 1.1e-200]), (None, [1.0] * 4),
        (None, None), (11, [-1.0] * 4), (12, [-0.0, 0.0, 0.0, 0.0]),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
