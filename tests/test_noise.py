import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.hashing import digest_int, hash_key
from kinfold.operators import noise as N


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(0)
    rows = [(i, list(range(1000)), (rng.random(1000) + 0.5).tolist()) for i in range(10)] + [(10, [], [])]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").persist()


def rows(df):
    return {r.id: dict(zip(r.idx, r.val)) for r in df.collect()}


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_masking(packed, method):
    before = rows(packed)
    assert rows(N.masking_noise(packed, 0.0, "id", method=method)) == before
    assert all(not r for r in rows(N.masking_noise(packed, 1.0, "id", method=method)).values())
    after = rows(N.masking_noise(packed, 0.3, "id", method=method))
    assert all(set(after[i].items()) <= set(before[i].items()) for i in before)
    kept = [len(after[i]) / 1000 for i in range(10)]
    assert all(0.63 < k < 0.77 for k in kept) and len(set(kept)) > 1
    other = rows(N.masking_noise(packed, 0.3, "id", epoch=2, method=method))
    assert other != after and after == rows(N.masking_noise(packed, 0.3, "id", method=method))
    with pytest.raises(ValueError):
        N.masking_noise(packed, 1.5, "id")


def test_salt_and_pepper(packed):
    before = rows(packed)
    high = max(v for r in before.values() for v in r.values())
    after = rows(N.salt_pepper_noise(packed, 300, 1000, "id"))
    for i in range(10):
        changed = {k for k in range(1000) if after[i].get(k, 0.0) != before[i].get(k, 0.0)}
        assert 200 < len(changed) <= 300
        assert all(after[i].get(k, 0.0) in (0.0, high) for k in changed)
        peppered = sum(k not in after[i] for k in changed)
        assert 0.3 < peppered / len(changed) < 0.7
    assert set(after[10].values()) == {high}  # an empty row gets entries too
    assert rows(N.salt_pepper_noise(packed, 0, 1000, "id")) == before


def test_decay_and_dispatch(packed):
    before = rows(packed)
    after = rows(N.corrupt(packed, "decay", 0.25, 1000, "id"))
    assert after[3] == pytest.approx({k: v * 0.75 for k, v in before[3].items()})
    assert rows(N.corrupt(packed, "none", 0.25, 1000, "id")) == before
    with pytest.raises(ValueError, match="corr_type"):
        N.corrupt(packed, "blur", 0.25, 1000, "id")


def test_salt_and_pepper_draws_are_the_digests(spark):
    """The draws are those of ``hash_key``, made and merged outside of the array functions, which take them one by one."""
    data = [(7, [3, 5, 3], [2.0, 4.0, 9.0], "a"), (None, [], [], "b"), (9, None, None, "c"), (11, [1, 2], [0.0, None], "d")]
    df = spark.createDataFrame(data, "id long, idx array<int>, val array<double>, other string")
    noisy = N.salt_pepper_noise(df, 40, 50, "id", extremes=(0.0, 8.0))
    got = {r.other: r for r in noisy.collect()}
    assert noisy.columns == df.columns and got["c"].idx is None and got["c"].val is None
    draws = spark.range(1, 41).select(F.col("id").alias("n"), F.explode(F.array(F.lit(7), F.lit(None), F.lit(11))).alias("key"))
    digest = hash_key("42:0", F.col("key"), F.col("n"))
    rows = draws.select("key", "n", (digest_int(digest, 0) % 50).alias("i"), (digest_int(digest, 1) % 2).alias("c")).collect()
    for key, other, old in ((7, "a", {3: 9.0, 5: 4.0}), (None, "b", {}), (11, "d", {})):
        want = dict(old)
        for r in sorted((r for r in rows if r.key == key), key=lambda r: r.n):
            want[r.i] = 0.0 if r.c == 0 else 8.0
        assert dict(zip(got[other].idx, got[other].val)) == {i: v for i, v in want.items() if v}
        assert got[other].idx == sorted(got[other].idx)
    assert "sort_array" not in noisy._jdf.queryExecution().toString()
