"""Fingerprints bit by bit, and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import simhash as S


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def texts():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = ["", None, "One", "ONE two", "a b c", "É b c d", "é b c d", "x " * 5000]
    for _ in range(30):
        base = [draw.choice(words) for _ in range(draw.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 5)):
            base = list(base)
            base[draw.randrange(len(base))] = draw.choice(words)
            out.append("\t ".join(base))
    return out


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in texts():
        assert S.fingerprint(text or "") % (1 << 64) == slow_fingerprint(text)


def test_components_equal_all_pairs(spark):
    rows = [(100 - i, t) for i, t in enumerate(texts())] + [(None, "a b c"), (50, "again"), (50, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))
    prints = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((repr(i), p, repr(least.get(r))) for (i, _), p, r in zip(rows, prints, roots))
    got = S.near_duplicates(docs).collect()
    assert sorted((repr(r.doc_id), r.fp % (1 << 64), repr(r.component_id)) for r in got) == want
    kept = S.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def _close_prints(seed, n):
    draw = random.Random(seed)
    found = set()
    for _ in range(n):
        centre = draw.getrandbits(64)
        for _ in range(draw.randint(1, 30)):
            flips = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5)))
            found.add(centre ^ flips)
    return sorted(found)


def _classes(spark, prints, **options):
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    frame = spark.createDataFrame(signed, "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.link_edges(frame, **options).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    found = S.components(spark.createDataFrame([(int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))) for a, b in edges], "a long, b long"))
    roots = {r.node % (1 << 64): r.root for r in found.collect()}
    groups = {}
    for p in prints:
        groups.setdefault(roots.get(p, f"alone {p}"), set()).add(p)
    return sorted(map(sorted, groups.values()))


def test_links_and_the_way_for_large_buckets_equal_all_pairs(spark):
    prints = _close_prints(5, 25)
    groups = {}
    for p, r in zip(prints, slow_components(prints)):
        groups.setdefault(r, set()).add(p)
    want = sorted(map(sorted, groups.values()))
    assert _classes(spark, prints) == want
    assert _classes(spark, prints, bucket=3) == want


def test_buckets_across_batches():
    import pyarrow as pa

    keys = np.array([1, 1, 2, 2, 2, 2, 3, 4, 4], np.int64)
    prints = np.array([0, 1, 8, 9, 1 << 40 | 8, 9 << 8, 5, 7, 255], np.int64)
    whole = list(S._linked([pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints)], names=["variant", "fp"])], 4, 100))
    single = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + 1]), pa.array(prints[i : i + 1])], names=["variant", "fp"])
        for i in range(len(keys))
    ]
    cut = list(S._linked(single, 4, 100))
    pairs = lambda found: sorted({tuple(sorted((x["a"], x["b"]))) for b in found for x in b.to_pylist()})
    assert pairs(whole) == pairs(cut) and pairs(whole)
    large = [x for b in S._linked(single, 4, 3) for x in b.to_pylist() if x["large"]]
    assert sorted(x["a"] for x in large) == sorted(prints[2:6].tolist())


def test_chain_and_empty_components(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = S.components(chain).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).count() == 0 and S.representatives(none).count() == 0


def test_odd_distances_are_refused_whatever_the_data(spark):
    prints = spark.createDataFrame([(1,)], "fp long")
    with pytest.raises(ValueError, match="even"):
        S.link_edges(prints, distance=3)
