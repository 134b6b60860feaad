import random

import pytest

from kinfold.operators import mining as M


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, c string")
    return {r.id: r for r in M.mine_triplets(df, "id", "c", "id", **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_triplet_properties_with_a_hot_category(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])) for i in range(120)]
    got = mined(spark, rows, seed=seed)
    cate = dict(rows)
    groups = {}
    for i, c in rows:
        groups.setdefault(c, []).append(i)
    for c, ids in groups.items():
        if c is None:
            assert all(got[i].valid_triplet_data == 0 for i in ids)
            continue
        assert [got[i].id_pos for i in ids] == [*ids[1:], None]
        negatives = [got[i].id_neg for i in ids[:-1]]
        assert len(set(negatives)) == len(negatives)
        assert all(cate[n] != c for n in negatives)
        assert got[ids[-1]].id_neg is None and got[ids[-1]].valid_triplet_data == 0
        assert all(got[i].valid_triplet_data == 1 for i in ids[:-1])


def test_category_bounds(spark):
    rows = [(i, c) for i, c in enumerate("aaaabbc")]
    got = mined(spark, rows, min_cate=2, max_cate=3)
    assert {i for i, r in got.items() if r.valid_triplet_data} == {4}


def test_too_few_negatives_is_an_error(spark):
    with pytest.raises(ValueError, match="fewer articles outside"):
        mined(spark, [(i, "a") for i in range(6)] + [(9, "b")])


def test_nearest_positive(spark):
    rows = [(1, "a"), (5, "a"), (7, "a"), (9, "a"), (6, "b"), (30, "b"), (8, "z")]
    df = spark.createDataFrame(rows, "id long, c string")
    got = {r.id: r.id_pos for r in M.nearest_positive(df, "id", "c").collect()}
    assert got == {1: 5, 5: 7, 7: 5, 9: 7, 6: 30, 30: 6, 8: None}


def test_gather_content(spark):
    rows = [(i, c, f"t{i}") for i, c in enumerate("aabb")]
    df = spark.createDataFrame(rows, "id long, c string, t string")
    out = M.gather_triplet_content(M.mine_triplets(df, "id", "c", "id"), "id", "t").collect()
    assert {r.id for r in out} == {0, 2}
    assert all(r.t_pos == f"t{r.id_pos}" and r.t_neg == f"t{r.id_neg}" for r in out)
