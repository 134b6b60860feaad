import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.functions.permutation import permuted
from kinfold.operators import blocks as B
from kinfold.operators import evaluate as E
from kinfold.operators import pruned as R
from kinfold.operators import sampling as P
from kinfold.operators import similarity as S

GOLDEN = [[1, 1, 0, 1], [0, 1, 0, 1], [0, 1, 1, 1]]
EXPECTED = {(0, 1): 0.816496580927726, (0, 2): 0.6666666666666669, (1, 2): 0.816496580927726}


def dense(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    rows = [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, vec array<double>, label long")


def packed(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    rows = [
        (i, [j for j, v in enumerate(r) if v], [float(v) for v in r if v], int(c))
        for i, (r, c) in enumerate(zip(x, labels))
    ]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, label long")


@pytest.mark.parametrize("make", [dense, packed])
def test_golden_cosine(spark, make):
    got = {(r.id_a, r.id_b): r.score for r in S.pairwise_similarity(make(spark, GOLDEN), "id").collect()}
    assert got == pytest.approx(EXPECTED)
    full = S.pairwise_similarity(make(spark, GOLDEN), "id", with_diagonal=True).collect()
    assert {(r.id_a, r.id_b): r.score for r in full if r.id_a == r.id_b} == {(i, i): 0.0 for i in range(3)}


def data(n=90, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.6)
    x[5] = 0
    x[7] = x[8]  # an exact copy
    labels = np.where(rng.random(n) < 0.34, 0, rng.integers(-1, 4, n))
    return x, labels


def scores(x, metric, norm=""):
    y = x.copy()
    if norm:
        s = {"l1": np.abs(y).sum(1), "l2": np.sqrt((y * y).sum(1)), "max": np.abs(y).max(1)}[norm]
        y = y / np.where(s == 0, 1, s)[:, None]
    if metric == "cosine":
        s = np.sqrt((y * y).sum(1))
        y = y / np.where(s == 0, 1, s)[:, None]
    return y @ y.T


@pytest.mark.parametrize("make", [dense, packed])
@pytest.mark.parametrize("metric,norm", [("cosine", ""), ("linear kernel", "l1"), ("linear kernel", "max"), ("cosine", "l2")])
def test_pairs_over_many_blocks(spark, make, metric, norm):
    x, _ = data()
    want = scores(x, metric, norm)
    pairs = S.pairwise_similarity(make(spark, x), "id", metric, norm, block_rows=20).collect()
    assert len({(r.id_a, r.id_b) for r in pairs}) == len(pairs) == 90 * 89 // 2
    assert all(abs(r.score - want[r.id_a, r.id_b]) < 1e-12 for r in pairs)


@pytest.mark.parametrize("make", [dense, packed])
def test_most_similar_takes_lowest_id_on_ties(spark, make):
    x, _ = data()
    want = np.round(scores(x, "cosine"), 9)
    np.fill_diagonal(want, -np.inf)
    got = {r.id: (r.best_id, r.score) for r in S.most_similar(make(spark, x), "id", block_rows=20).collect()}
    assert got == {i: (int(want[i].argmax()), pytest.approx(want[i].max())) for i in range(90)}
    np.fill_diagonal(want, 0.0)
    zeroed = {r.id: r.best_id for r in S.most_similar(make(spark, x), "id", self_score=0.0, block_rows=20).collect()}
    assert zeroed == {i: int(want[i].argmax()) for i in range(90)}


def brute(x, labels, metric="cosine", digits=6):
    s = np.rint(scores(x, metric) * 10**digits) / 10**digits
    i, j = np.triu_indices(len(x), 1)
    known = (labels[i] >= 0) & (labels[j] >= 0)
    return s[i, j][known], (labels[i] == labels[j])[known]


@pytest.mark.parametrize("metric", ["cosine", "linear kernel"])
def test_auroc_box_and_roc(spark, metric):
    x, labels = data()
    s, related = brute(x, labels, metric)
    hist = S.score_histogram(packed(spark, x, labels), "id", ["label"], metric, block_rows=20)
    pos, neg = s[related], s[~related]
    area = sum((neg < p).sum() + (neg == p).sum() / 2 for p in pos) / len(pos) / len(neg)
    row = E.auroc(hist).first()
    assert (row.related_pairs, row.unrelated_pairs) == (len(pos), len(neg))
    assert row.auroc == pytest.approx(area)
    counts = S.related_counts(dense(spark, x, labels), "label").first()
    assert tuple(counts) == (len(pos), len(neg))
    for r in E.box_stats(hist).collect():
        v = pos if r.related else neg
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        inside = v[(v <= q3 + 1.5 * (q3 - q1)) & (v >= q1 - 1.5 * (q3 - q1))]
        assert (r.q1, r.med, r.q3) == pytest.approx((q1, med, q3))
        assert (r.whislo, r.whishi) == pytest.approx((inside.min(), inside.max()))
        assert r.fliers == len(v) - len(inside) and r.n == len(v)
    every = sorted(E.roc_curve(hist, drop_intermediate=False).collect(), key=lambda r: -r.threshold)
    kept = E.roc_curve(hist).collect()
    fpr, tpr = np.array([r.fpr for r in every]), np.array([r.tpr for r in every])
    assert np.trapezoid(tpr, fpr) == pytest.approx(area)
    kept = sorted(kept, key=lambda r: -r.threshold)
    assert np.trapezoid([r.tpr for r in kept], [r.fpr for r in kept]) == pytest.approx(area)
    assert len(kept) <= len(every) and (kept[0].fpr, kept[0].tpr) == (0, 0) and (kept[-1].fpr, kept[-1].tpr) == (1, 1)


def test_auroc_without_related_pairs_is_null(spark):
    x, _ = data(10)
    hist = S.score_histogram(dense(spark, x, range(10)), "id", ["label"])
    assert E.auroc(hist).first().auroc is None


def test_histogram_diagonal(spark):
    x, _ = data(20)
    plain = S.score_histogram(dense(spark, x), "id").agg(F.sum("n")).first()[0]
    real = S.score_histogram(dense(spark, x), "id", diagonal="real")
    assert plain == 190 and real.agg(F.sum("n")).first()[0] == 210
    assert real.filter("score = 1").agg(F.sum("n")).first()[0] >= 19


def test_capped_sample(spark):
    x, labels = data()
    labels = np.array(labels)
    s, related = brute(x, labels, digits=9)
    whole = P.capped_sample(dense(spark, x, labels), "id", "label", cap=10**6).collect()
    assert len(whole) == len(s) == len({(r.id_a, r.id_b) for r in whole})
    few = P.capped_sample(dense(spark, x, labels), "id", "label", cap=50).collect()
    assert sum(r.related for r in few) == 50 and len(few) == len({(r.id_a, r.id_b) for r in few}) == 100
    want = scores(x, "cosine")
    for r in few:
        assert r.id_a < r.id_b and (labels[r.id_a] == labels[r.id_b]) == r.related
        assert r.score == pytest.approx(want[r.id_a, r.id_b])
    again = P.capped_sample(dense(spark, x, labels).repartition(3), "id", "label", cap=50).collect()
    assert {(r.id_a, r.id_b) for r in few} == {(r.id_a, r.id_b) for r in again}
    other = P.capped_sample(dense(spark, x, labels), "id", "label", cap=50, seed=7).collect()
    assert {(r.id_a, r.id_b) for r in few} != {(r.id_a, r.id_b) for r in other}


def test_sample_of_classes_of_all_sizes(spark):
    """One class with most rows, many with one or two, unknown labels, sparse rows."""
    labels = [0] * 40 + [k for k in range(1, 16) for _ in range(1 + k % 2)] + [-1, None]
    rows = [(3 * i, [i % 5, 5 + i % 3], [1.0, 2.0], k) for i, k in enumerate(labels)]
    frame = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, label int")
    known = [(i, k) for i, k in enumerate(labels) if k is not None and k >= 0]
    pairs = {(3 * i, 3 * j): a == b for n, (i, a) in enumerate(known) for j, b in known[n + 1 :]}
    got = P.capped_sample(frame, "id", "label", cap=10**6).collect()
    assert {(r.id_a, r.id_b): r.related for r in got} == pairs and len(got) == len(pairs)
    for r in got:
        a, b = r.id_a // 3, r.id_b // 3
        assert r.score == pytest.approx(0.2 * (a % 5 == b % 5) + 0.8 * (a % 3 == b % 3))
    few = P.capped_sample(frame, "id", "label", cap=30).collect()
    assert len({(r.id_a, r.id_b) for r in few}) == 60 and all(pairs[r.id_a, r.id_b] == r.related for r in few)
    assert P.capped_sample(frame.where("label = 3"), "id", "label").count() == 1
    assert P.capped_sample(frame.limit(0), "id", "label").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation_is_one(spark, n):
    rows = spark.range(n).select(permuted(F.col("id"), n, "s").alias("a"), permuted(F.col("id"), n, "t").alias("b")).collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    if n > 100:
        assert sum(r.a == r.b for r in rows) < 20 and sum(r.a == i for i, r in enumerate(rows)) < 20


def test_permutation_of_many_numbers(spark):
    n = 3 * 10**18 + 7
    ids = spark.range(n - 500, n).select(permuted(F.col("id"), n, 1).alias("a"))
    got = [r.a for r in ids.collect()]
    assert len(set(got)) == 500 and all(0 <= a < n for a in got) and max(got) - min(got) > n // 2


def test_best_matches_of_some_rows(spark):
    x, labels = data()
    frame = dense(spark, x, labels)
    whole = {r.id: (r.best_id, r.score) for r in S.most_similar(frame, "id").collect()}
    some = S.most_similar(frame, "id", of=spark.createDataFrame([(3,), (7,), (7,)], "id long")).collect()
    assert {r.id: (r.best_id, pytest.approx(r.score)) for r in some} == {i: whole[i] for i in (3, 7)}


def test_several_kinds_in_one_pass(spark):
    x, labels = data()
    frame = dense(spark, x, labels).withColumn("half", F.slice("vec", 1, 3))
    kinds = {"whole": (None, "vec"), "half": (None, "half")}
    both = S.score_histogram(frame, "id", ["label"], kinds=kinds, digits=3)
    best = S.most_similar(frame, "id", kinds=kinds)
    for kind, col in (("whole", "vec"), ("half", "half")):
        alone = frame.select("id", F.col(col).alias("vec"), "label")
        want = sorted(map(tuple, S.score_histogram(alone, "id", ["label"], digits=3).collect()))
        assert sorted(map(tuple, both.where(F.col("kind") == kind).drop("kind").collect())) == want
        want = sorted(map(tuple, S.most_similar(alone, "id").collect()))
        assert sorted(map(tuple, best.where(F.col("kind") == kind).drop("kind").collect())) == want


@pytest.mark.parametrize("sparse", [False, True])
def test_pruned_pairs_are_all_pairs(spark, sparse):
    """Clustered rows: most tiles are skipped, and nothing is lost."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    x = np.concatenate([centres[i % 12] + 0.05 * draw.normal(size=16) for i in range(240)]).reshape(240, 16)
    x[17] = x[18] = 0
    rows = [(i, list(range(16)), r.tolist()) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>")
    frame = frame if sparse else frame.select("id", F.col("val").alias("vec"))
    want = sorted(map(tuple, S.most_similar(frame, "id").collect()))
    best, tiles = R.most_similar(frame, "id", block_rows=10, pivots=40)
    got = sorted(map(tuple, best.collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(a[2] == pytest.approx(b[2]) for a, b in zip(got, want))
    n, kept = tiles.count(), tiles.where("kept").count()
    assert kept < 0.5 * n
    close = {(r.id_a, r.id_b) for r in S.pairwise_similarity(frame, "id", min_score=0.9).collect()}
    pairs, tiles = R.pairs_above(frame, "id", 0.9, block_rows=10, pivots=40)
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == close and close
    assert tiles.where("kept").count() < 0.5 * tiles.count()
    empty, _ = R.most_similar(frame.limit(0), "id")
    assert empty.count() == 0


def test_blocks_meet_without_copies_of_their_rows(spark):
    """Every pair of blocks is one tile, and no row is copied for the tiles it is in."""
    x, _ = data()
    frame = dense(spark, x).select("id", "vec")
    paired = B.block_pairs(frame, "id", 5)
    plan = paired._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan

    def sizes(batches):
        for left, right, same in B.tiles(batches):
            ids = [pa.array([B.column(side, "id").tolist()], pa.list_(pa.int64())) for side in (left, right)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array([same])], names=["a", "b", "same"])

    found = paired.mapInArrow(sizes, "a array<bigint>, b array<bigint>, same boolean").collect()
    met = [tuple(sorted((i, j))) for r in found for i in r.a for j in r.b if not r.same or i < j]
    n = len(x)
    assert len(met) == len(set(met)) == n * (n - 1) // 2
    assert all(r.a == r.b for r in found if r.same)
    k = B.block_count(n, B.tasks_of(spark), 5)
    block = {r.id: r.b for r in frame.select("id", F.pmod(F.xxhash64("id"), F.lit(k)).alias("b")).collect()}
    assert all(block[r.a[0]] < block[r.b[0]] for r in found if not r.same)


def test_block_count_keeps_blocks_bounded():
    assert B.block_count(10, 8, 8192) == 1
    assert B.block_count(10**6, 8, 8192) == -(-(10**6) // 8192)
    assert B.block_count(0, 8, 8192) == 1
    # As few copies as the tasks allow, until memory asks for more.
    assert B.block_count(10**6, 4000, 10**6) == 179
    rows = B.rows_per_block(10**9, 512 * 10**9)
    assert rows * 512 <= B.BLOCK_BYTES and B.block_count(10**9, 4000, rows) == -(-(10**9) // rows)


def test_bad_metric(spark):
    with pytest.raises(ValueError, match="metric"):
        S.pairwise_similarity(dense(spark, GOLDEN), "id", metric="euclidean")


@pytest.mark.parametrize("least", [0.2, 0.5, 0.95])
def test_term_join_equals_all_pairs(spark, least):
    from kinfold.operators.term_join import pairs_above

    draw = np.random.default_rng(7)
    rows, dense = [], np.zeros((60, 40))
    for i in range(60):
        idx = np.sort(draw.choice(40, draw.integers(0, 9), replace=False))
        idx = idx if i % 7 else idx[:1]
        val = draw.normal(size=len(idx)) + 1
        if i % 10 == 9:
            idx, val = rows[-1][1], rows[-1][2]
        rows.append((i, [int(t) for t in idx], [float(v) for v in val]))
        dense[i, list(idx)] = val
    frame = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>")
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    score = (dense / np.where(norm == 0, 1, norm)) @ (dense / np.where(norm == 0, 1, norm)).T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if score[i, j] >= least}
    got = {(r.id_a, r.id_b): r.score for r in pairs_above(frame, "id", least).collect()}
    assert set(got) == want and all(np.isclose(got[p], score[p]) for p in want)


def test_histogram_holds_few_scores(monkeypatch):
    """Strips and held counts are bounded by a number of scores, in 32 bits where the scores are bounded."""
    import pyarrow as pa

    from kinfold.operators import blocks as B
    from kinfold.operators import similarity as S

    n = 5000
    rows = B.Rows(pa.table({"vec": pa.array(np.ones((n, 1)).tolist(), pa.list_(pa.float64()))}))
    assert max(score.size for _, score in B.dot_strips(rows, rows)) <= 1 << 20
    total = S._Totals(True, 1001)
    held = 0
    for _ in range(3):
        total.add(np.full(600_000, 7, np.int32))
        assert all(keys.dtype == np.int32 for keys in total.held)
        held = max(held, sum(len(keys) for keys in total.held))
    assert held <= 1_600_000
    assert sum(sum(b.column("n").to_pylist()) for b in total.batches(0)) == 1_800_000




@pytest.mark.parametrize("share, cells, products, table", [(0.008, 1 << 22, 1 << 16, 1 << 22), (2.0, 1, 7, 1), (0.0, 1, 1, 1), (0.1, 300, 50, 1)])
def test_sparse_products_read_lists_of_rare_columns(monkeypatch, share, cells, products, table):
    """Columns of few pairs are never made dense; kinds with equal indices share the pass, and even ones are counted."""
    for name, value in {"_DENSE_SHARE": share, "_DENSE_CELLS": cells, "_PRODUCTS": products, "_TABLE": table, "_MIN_COLUMNS": 3}.items():
        monkeypatch.setattr(B, name, value)
    monkeypatch.setattr(B.Rows, "densify", lambda *_: pytest.fail("all shared columns were made dense"))
    rng = np.random.default_rng(5)

    def side(n):
        x = rng.normal(size=(n, 60)) * (rng.random((n, 60)) < np.linspace(0.9, 0.01, 60))
        x[3] = 0
        even = (x != 0) * rng.random((n, 1))
        rows = []
        for values in (x, even):
            idx, val = [np.flatnonzero(r).tolist() for r in x], [v[r != 0].tolist() for v, r in zip(values, x)]
            rows.append(B.Rows(pa.table({"idx": pa.array(idx, pa.list_(pa.int32())), "val": pa.array(val, pa.list_(pa.float64()))})))
        return (x, even), rows

    (left, lrows), (right, rrows) = side(70), side(45)
    lrows, rrows, left, right = [*lrows, lrows[0]], [*rrows, rrows[1]], [*left, left[0]], [*right, right[1]]
    found = [np.concatenate(s) for s in zip(*[scores for _, scores in B.kind_strips(lrows, rrows, 16)])]
    for got, a, b in zip(found, left, right):
        assert np.allclose(got, a @ b.T, atol=1e-12)


def test_labels_counted_together(spark):
    """Two labels, some of them unknown, of two kinds over one column of indices: each as if it were alone."""
    x, labels = data()
    rows = packed(spark, x, labels).withColumn("other", F.col("id") % 5).withColumn("one", F.transform("val", lambda _: F.lit(1.0)))
    known = rows.where("label >= 0")
    kinds = {"plain": ("idx", "val"), "even": ("idx", "one")}
    for some in (rows, known):
        both = S.score_histogram(some, "id", ["label", "other"], kinds=kinds, block_rows=20).collect()
        got = {(r.kind, r.label_kind, r.related, r.score): r.n for r in both}
        want = {}
        for kind, (_, values) in kinds.items():
            for label in ("label", "other"):
                one = some.select("id", "idx", F.col(values).alias("val"), label)
                want |= {(kind, label, r.related, r.score): r.n for r in S.score_histogram(one, "id", [label]).collect()}
        assert got == want


@pytest.mark.parametrize("many", [-1, 1e9])
def test_term_join_finishes_alone_or_together(spark, monkeypatch, many):
    """Tiles where most pairs stay in the running are finished by products of the whole tile."""
    from kinfold.operators import term_join as TJ

    rng = np.random.default_rng(11)
    x = rng.random((60, 80)) * (rng.random((60, 80)) < np.linspace(0.8, 0.02, 80))
    x[4] = 0
    x[9] = x[2]
    offsets = np.append(0, np.cumsum((x != 0).sum(1)))
    order = np.argsort((x != 0).sum(0), kind="stable")  # rising frequency
    at = [[int(c) for c in order if r[c]] for r in x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]]
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    terms = pa.array(at, pa.list_(pa.int64()))
    rows = pa.table({"terms": terms, "val": pa.array([[r[c] for c in cols] for r, cols in zip(unit, at)], pa.list_(pa.float64()))})
    monkeypatch.setattr(TJ, "_MANY", many, raising=True)
    monkeypatch.setattr(TJ, "_PRODUCTS", 40)
    strips = []
    monkeypatch.setattr(TJ.SparseTile, "strip", lambda self, s, e, f=B.SparseTile.strip: strips.append(s) or f(self, s, e))
    found = [np.stack(f, 1) for f in TJ._Index(rows, 0.3).above(rows, 0.3)]
    got = {(int(i), int(j)): s for i, j, s in np.concatenate(found)}
    score = unit @ unit.T
    want = {(i, j): score[i, j] for i in range(60) for j in range(60) if score[i, j] >= 0.3}
    assert got == pytest.approx(want) and bool(strips) == (many < 0) and offsets[-1] > 500


def test_dense_blocks_are_small(spark, monkeypatch):
    """Blocks without sparse vectors have a bound of their own, which the pairs do not depend on."""
    monkeypatch.setattr(B, "_MIN_ROWS", 10)
    monkeypatch.setattr(B, "_DENSE_BYTES", 2000)
    x, _ = data(n=200, d=50)
    frame = dense(spark, x).select("id", "vec")
    assert B.block_pairs(frame, "id").select("_l").distinct().count() == 20
    assert S.score_histogram(frame, "id", digits=3).agg(F.sum("n")).first()[0] == 200 * 199 // 2


def test_term_join_of_repeated_terms(monkeypatch):
    """Rows that share an id have their terms twice; both ways of finishing score them alike."""
    from kinfold.operators import term_join as TJ

    rng = np.random.default_rng(2)
    at = [sorted(rng.integers(0, 30, rng.integers(0, 40)).tolist()) for _ in range(50)]
    rows = pa.table({"terms": pa.array(at, pa.list_(pa.int64())), "val": pa.array([(rng.random(len(t)) / 4).tolist() for t in at], pa.list_(pa.float64()))})
    found = []
    for many in (-1, 1e9):
        monkeypatch.setattr(TJ, "_MANY", many)
        pairs = [np.stack(f, 1) for f in TJ._Index(rows, 0.2).above(rows, 0.2)]
        found.append({(int(i), int(j)): s for i, j, s in np.concatenate(pairs)})
    assert len(found[0]) > 100 and found[0] == pytest.approx(found[1])
