import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators import articles as A
from kinfold.operators import ordering as O


def test_text_functions(spark):
    rows = [(1, "A cat's 12 éa 12ab x_1 ab"), (2, "  \t\n　"), (3, None), (4, "ok")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert [r.id for r in A.clean(df, "t").orderBy("id").collect()] == [1, 4]
    got = df.filter("id = 1").select(
        T.word_tokens(F.col("t")).alias("w"),
        T.filter_tokens(T.word_tokens(F.col("t"))).alias("f"),
        T.term_counts(F.array(*[F.lit(x) for x in "b a b c b".split()])).alias("c"),
        T.remove_stop_words(F.array(F.lit("the"), F.lit("cat")), T.default_stop_words()).alias("s"),
    ).first()
    assert got.w == ["cat", "12", "éa", "12ab", "x_1", "ab"]
    assert got.f == ["cat", "éa", "12ab", "x_1", "ab"]
    assert [(x.term, x.n) for x in got.c] == [("a", 1), ("b", 3), ("c", 1)]
    assert got.s == ["cat"]
    empty = df.limit(1).select(T.term_counts(F.array().cast("array<string>")).alias("c")).first()
    assert empty.c == []


def test_story_and_category(spark):
    rows = [(1, "【食物設計（下）】x", "即時時事"), (2, "no", "即政治"), (3, "【】a", None), (4, "a【b|c】", "港")]
    df = spark.createDataFrame(rows, "id long, title string, c string")
    got = A.with_plain_category(A.with_story(df), "c").orderBy("id").collect()
    assert [r.story for r in got] == ["食物設計", None, "", "b"]
    assert [r.c for r in got] == ["事", "政治", None, "港"]
    kept = df.withColumn("story", F.lit("z"))
    assert A.with_story(kept).first().story == "z"


def test_label_valid_bounds(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("aaabbc")] + [(6, None)], "id long, v string")

    def flags(**kw):
        return [r.f for r in A.label_valid(df, "v", "f", **kw).orderBy("id").collect()]

    assert flags() == [1, 1, 1, 1, 1, 1, 0]
    assert flags(min_count=2, max_count=2) == [0, 0, 0, 1, 1, 0, 0]
    assert flags(min_count=2, deny=("a",)) == [0, 0, 0, 1, 1, 0, 0]


def test_factorize_orders_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, v string")
    assert [r.c for r in A.factorize(df, "v", "id", "c").orderBy("id").collect()] == [0, -1, 1, 0]
    assert [r.c for r in A.factorize(df, "v", "id", "c", descending=True).orderBy("id").collect()] == [0, -1, 1, 0]


@pytest.mark.parametrize("train,validate", [(3, 2), (0, 4), (20, 5), (4, 0)])
def test_latest_split(spark, train, validate):
    ids = [5, 9, 1, 7, 30, 12, 2]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    latest = sorted(sorted(ids, reverse=True)[: train + validate])
    want = {i: "train" if k < train else "validate" for k, i in enumerate(latest)}
    assert {r.id: r.split for r in A.latest_split(df, "id", train, validate).collect()} == want


def test_latest_split_ranks_ids(spark):
    df = spark.range(50).select(F.col("id"))
    got = {r.id: r.split for r in A.latest_split(df, "id", 10, 5).collect()}
    assert got == {i: "train" if i < 45 else "validate" for i in range(35, 50)}


def test_require_reports_all_failures(spark):
    df = spark.range(3)
    A.require(df, {"ok": F.max("id") == 2})
    with pytest.raises(ValueError, match="too small"):
        A.require(df, {"too small": F.max("id") > 5, "ok": F.min("id") == 0})


def test_positions_are_exact_under_skew(spark):
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k long").repartition(5)
    got = O.sorted_position(df, [F.col("k"), F.col("id")]).orderBy("pos").collect()
    assert [(r.k, r.id) for r in got] == sorted((k, i) for i, k in rows)
    assert [r.pos for r in got] == list(range(200))
    hashed = O.hash_position(df, "id", 1).collect()
    assert sorted(r.pos for r in hashed) == list(range(200))
    assert {r.id: r.pos for r in hashed} == {r.id: r.pos for r in O.hash_position(df, "id", 1).collect()}


def test_lookup_join_salted_equals_broadcast(spark):
    big = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(60)], "id long, k long")
    small = spark.createDataFrame([(i, i * 10) for i in range(0, 60, 2)] + [(1, 5)], "k long, v long")
    for how in ("left", "inner"):
        a = {(r.id, r.v) for r in O.lookup_join(big, small, "k", how, salt_on="id").collect()}
        b = {(r.id, r.v) for r in O.lookup_join(big, small, "k", how, salt_on="id", max_rows=0).collect()}
        assert a == b and len(a) == (60 if how == "left" else len(a))


def test_rank_distinct_falls_back_to_range_sort(spark, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_ROWS", 5)
    df = spark.range(40).select((40 - F.col("id")).alias("v"))
    got = O.rank_distinct(df, [F.col("v")], "p").collect()
    assert {r.v: r.p for r in got} == {v: v - 1 for v in range(1, 41)}


def test_streaming_rows_can_be_cleaned(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, "【a（b】", "x"), (2, "t", " ")], "id long, title string, main_content string").write.parquet(path)
    stream = spark.readStream.schema("id long, title string, main_content string").parquet(path)
    done = A.with_story(A.clean(stream)).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert [(r.id, r.story) for r in spark.table("cleaned").collect()] == [(1, "a")]


def test_splits_cut_by_position_on_ties(spark):
    rows = [(i, (i * 7) % 4) for i in range(12)]
    df = spark.createDataFrame(rows + [(12, None)], "id long, n long")
    for train, validate in [(4, 4), (0, 3), (5, 0), (13, 2), (6, 7), (20, 20)]:
        by = sorted(df.collect(), key=lambda r: (r.n is not None, r.n or 0, r.id))
        want = {r.id: "train" if k < train else "validate" for k, r in enumerate(by) if k < train + validate}
        got = {r.id: r.split for r in A.positional_split(df, "n", train, validate, tie="id").collect()}
        assert got == want
        late = by[max(0, len(by) - train - validate) :]
        want = {r.id: "train" if k < train else "validate" for k, r in enumerate(late)}
        got = {r.id: r.split for r in A.latest_split(df, "n", train, validate, tie="id").collect()}
        assert got == want


def test_splits_refuse_ties_at_the_cut(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    assert A.positional_split(df, "id", 1, 2).count() == 3
    with pytest.raises(ValueError, match="tie"):
        A.positional_split(df, "id", 2, 1)
    assert A.latest_split(df.limit(0), "id", 2, 1).count() == 0
