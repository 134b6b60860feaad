import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder import math as M
from kinfold.encoder.model import EncoderModel, xavier_weights
from kinfold.encoder.training import DenoisingEncoder
from kinfold.operators.blocks import Rows
from kinfold.operators.noise import corrupt
from kinfold.operators.batches import assign_batches

N, V, K = 20, 12, 4


def sparse_rows(x):
    idx = [np.flatnonzero(r).tolist() for r in x]
    val = [r[r != 0].tolist() for r in x]
    return Rows(pa.table({"idx": pa.array(idx, pa.list_(pa.int32())), "val": pa.array(val, pa.list_(pa.float64()))}))


def matrix(seed=0):
    rng = np.random.default_rng(seed)
    return (rng.random((N, V)) < 0.35).astype(float)


def frame(spark, x, labels=None):
    labels = np.zeros(len(x)) if labels is None else labels
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist(), int(labels[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, label long")


@pytest.mark.parametrize("enc", ["sigmoid", "tanh", "none"])
@pytest.mark.parametrize("dec,loss", [("sigmoid", "cross_entropy"), ("tanh", "mean_squared"), ("none", "mean_squared"), ("sigmoid", "cosine_proximity"), ("none", "cosine_proximity")])
def test_gradient_by_finite_differences(enc, dec, loss):
    rng = np.random.default_rng(2)
    x = matrix()
    noisy = x * (rng.random(x.shape) > 0.3)
    params = M.Params(rng.normal(size=(V, K)) * 0.4, rng.normal(size=K) * 0.3, rng.normal(size=V) * 0.3)
    weight, pull = rng.random(N), rng.normal(size=(N, K))

    def total(p):
        f, g = M.ACT[enc][0], M.ACT[dec][0]
        h = f(noisy @ p.w + p.bh) - f(p.bh)
        return (M.loss_and_slope(x, g(h @ p.w.T + p.bv), loss)[0] * weight).sum() + (pull * h).sum()

    grad = M.Gradient(params)
    M.reconstruct(params, grad, sparse_rows(x), sparse_rows(noisy), 0, N, weight, pull, enc, dec, loss)
    step = 1e-6
    for name in ("w", "bh", "bv"):
        for at in np.ndindex(getattr(params, name).shape):
            p = {k: getattr(params, k).copy() for k in ("w", "bh", "bv")}
            p[name][at] += step
            up = total(M.Params(**p))
            p[name][at] -= 2 * step
            down = total(M.Params(**p))
            assert getattr(grad, name)[at] == pytest.approx((up - down) / (2 * step), abs=2e-6)


def test_update_rules():
    p = M.Params(np.ones((1, 1)), np.ones(1), np.ones(1))
    g = M.Gradient(p)
    g.w[:] = 2.0

    def run(opt, n=2):
        u, q = M.Updater(opt, 0.1, 0.5), p
        for _ in range(n):
            q = u.apply(q, g)
        return q.w[0, 0]

    assert run("gradient_descent") == pytest.approx(1 - 0.2 - 0.2)
    assert run("momentum") == pytest.approx(1 - 0.1 * 2 - 0.1 * (0.5 * 2 + 2))
    assert run("ada_grad") == pytest.approx(1 - 0.2 / np.sqrt(4.1) - 0.2 / np.sqrt(8.1))
    assert run("adam") == pytest.approx(0.8, abs=1e-6)


def test_xavier(spark):
    rows = xavier_weights(spark, 200, 10, const=2.0).orderBy("term_id").collect()
    w = np.array([r.w for r in rows])
    bound = 2 * np.sqrt(6 / 210)
    assert w.shape == (200, 10) and np.abs(w).max() <= bound and abs(w.mean()) < 0.03 * bound * 2
    assert w.std() == pytest.approx(bound / np.sqrt(3), rel=0.05)


def numpy_loop(x, labels, config, params, order):
    """Sequential training over the same batches and corrupted inputs."""
    updater = M.Updater(config.opt, config.learning_rate, config.momentum)
    f, df = M.ACT["sigmoid"]
    for noisy, batches in order:
        for b in sorted(set(batches)):
            at = np.flatnonzero(batches == b)
            fa = f(noisy[at] @ params.w + params.bh)
            h = fa - f(params.bh)
            weight, slope = np.ones(len(at)), None
            if config.triplet_strategy == "batch_all":
                weight, slope, dot, used = np.zeros(len(at)), np.zeros_like(h), h @ h.T, 0
                for a in range(len(at)):
                    for p in range(len(at)):
                        for n in range(len(at)):
                            if a == p or labels[at[a]] != labels[at[p]] or labels[at[a]] == labels[at[n]]:
                                continue
                            s = 1 / (1 + np.exp(-(dot[a, n] - dot[a, p])))
                            slope[a] += s * (h[n] - h[p])
                            slope[p] -= s * h[a]
                            slope[n] += s * h[a]
                            weight[[a, p, n]] += 1
                            used += 1
                slope = config.alpha * slope / (used + 1e-16)
            grad = M.Gradient(params)
            M.reconstruct(
                params, grad, sparse_rows(x[at]), sparse_rows(noisy[at]), 0, len(at), weight / (weight.sum() + 1e-16),
                slope, "sigmoid", "sigmoid", config.loss_func,
            )
            params = updater.apply(params, grad)
    return params


@pytest.mark.parametrize("strategy,opt,tile", [("none", "momentum", 1024), ("batch_all", "ada_grad", 1024), ("batch_all", "gradient_descent", 4)])
def test_training_equals_a_sequential_loop(spark, strategy, opt, tile):
    x, labels = matrix(5), np.arange(N) % 3
    config = EncoderConfig(
        compress_factor=3, num_epochs=2, batch_size=8, triplet_strategy=strategy, opt=opt, tile_rows=tile, verbose_step=1
    )
    df = frame(spark, x, labels)
    model = DenoisingEncoder(config).fit(df, V, "id", "label", valid=df)
    order = []
    for epoch in (1, 2):
        noisy = np.zeros_like(x)
        for r in corrupt(df, "masking", 0.3, V, "id", str(config.seed), epoch, "xxhash64").collect():
            noisy[r.id, r.idx] = r.val
        placed = {r.id: r.batch_id for r in assign_batches(df, "id", 8, config.seed, epoch).collect()}
        order.append((noisy, np.array([placed[i] for i in range(N)])))
    start = EncoderModel.initial(spark, config, V, "xxhash64").params()
    want = numpy_loop(x, labels, config, start, order)
    got = {r.term_id: r for r in model.weights.collect()}
    assert np.array([got[t].w for t in range(V)]) == pytest.approx(want.w, abs=1e-9)
    assert np.array([got[t].bv for t in range(V)]) == pytest.approx(want.bv, abs=1e-9)
    assert np.array(model.hidden_bias.first().bh) == pytest.approx(want.bh, abs=1e-9)
    metrics = model.metrics.collect()
    assert [(m.epoch, m.split) for m in metrics] == [(1, "train"), (1, "validate"), (2, "train"), (2, "validate")]
    assert metrics[3].cost < metrics[1].cost


def test_hard_training_is_the_same_in_one_or_many_tiles(spark):
    x, labels = matrix(6), np.arange(N) % 3
    df = frame(spark, x, labels)
    found = []
    for tile in (1024, 5):
        config = EncoderConfig(compress_factor=3, num_epochs=1, batch_size=10, triplet_strategy="batch_hard", tile_rows=tile, verbose_step=1)
        model = DenoisingEncoder(config).fit(df, V, "id", "label", valid=df)
        found.append((model.params().w, [tuple(m) for m in model.metrics.collect()]))
    assert found[0][0] == pytest.approx(found[1][0], abs=1e-9)
    assert found[0][1][0][2:] == pytest.approx(found[1][1][0][2:])


def test_explicit_triplets(spark):
    x = matrix(7)
    rows = []
    for i in range(N):
        row = [i]
        for k in (i, (i + 1) % N, (i + 7) % N):
            row += [np.flatnonzero(x[k]).tolist(), x[k][x[k] != 0].tolist()]
        rows.append(tuple(row))
    cols = "id long, " + ", ".join(f"idx_{r} array<int>, val_{r} array<double>" for r in ("org", "pos", "neg"))
    df = spark.createDataFrame(rows, cols)
    config = EncoderConfig(compress_factor=3, num_epochs=1, batch_size=N, corr_type="none", verbose_step=1, alpha=2.0)
    model = DenoisingEncoder(config).fit_triplets(df, V, "id", valid=df)
    start = EncoderModel.initial(spark, config, V, "xxhash64").params()

    def cost(p):
        total, h = 0.0, {}
        for name, shift in (("org", 0), ("pos", 1), ("neg", 7)):
            z = np.roll(x, -shift, axis=0)
            h[name] = M.sigmoid(z @ p.w + p.bh) - M.sigmoid(p.bh)
            total += M.loss_and_slope(z, M.sigmoid(h[name] @ p.w.T + p.bv), "cross_entropy")[0].mean()
        return total + 2 * M.softplus((h["org"] * (h["neg"] - h["pos"])).sum(1)).mean()

    metrics = model.metrics.collect()
    assert metrics[0].cost == pytest.approx(cost(start))
    assert metrics[1].cost == pytest.approx(cost(model.params())) and metrics[1].cost < metrics[0].cost
    step, moved = 1e-6, (start.w - model.params().w) / config.learning_rate
    for at in [(0, 0), (3, 2), (11, 3)]:
        up, down = start.w.copy(), start.w.copy()
        up[at] += step
        down[at] -= step
        want = (cost(M.Params(up, start.bh, start.bv)) - cost(M.Params(down, start.bh, start.bv))) / (2 * step)
        assert moved[at] == pytest.approx(want, abs=1e-5)
    same = df.withColumn("idx_neg", F.col("idx_pos")).withColumn("val_neg", F.col("val_pos"))
    with pytest.raises(ValueError, match="the same"):
        DenoisingEncoder(config).fit_triplets(same, V, "id")


def test_save_load_resume_and_join_transform(spark, tmp_path):
    x = matrix(8)
    x[4] = 0
    df = frame(spark, x)
    config = EncoderConfig(compress_factor=3, num_epochs=1, batch_size=10, triplet_strategy="none", opt="adam", verbose_step=1)
    model = DenoisingEncoder(config).fit(df, V, "id")
    model.save(str(tmp_path / "m"))
    back = EncoderModel.load(spark, str(tmp_path / "m"))
    assert back.steps == 2 and back.params().w == pytest.approx(model.params().w)
    p = back.params()
    want = M.sigmoid(x @ p.w + p.bh) - M.sigmoid(p.bh)
    for rows in (back.transform(df, "id"), back.transform_by_join(df, "id"), back.transform(frame_dense(spark, x), "id")):
        got = {r.id: r.embedding for r in rows.collect()}
        assert np.array([got[i] for i in range(N)]) == pytest.approx(want)
    limited = EncoderModel.load(spark, str(tmp_path / "m"), max_broadcast=10)
    assert np.array([r.embedding for r in limited.transform(df, "id").orderBy("id").collect()]) == pytest.approx(want)
    with pytest.raises(ValueError, match="exceed"):
        limited.params()
    again = DenoisingEncoder(config).fit(df, V, "id", resume_from=back)
    assert again.steps == 4
    fresh = DenoisingEncoder(config).fit(df, V, "id", resume_from=EncoderModel(model.weights, model.hidden_bias, V, K))
    assert np.abs(again.params().w - fresh.params().w).max() > 1e-6  # the slots matter


def frame_dense(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


def test_inputs_are_checked(spark):
    with pytest.raises(ValueError, match="labels"):
        DenoisingEncoder(EncoderConfig()).fit(frame(spark, matrix()), V, "id")
    with pytest.raises(ValueError, match="term index"):
        DenoisingEncoder(EncoderConfig(triplet_strategy="none", compress_factor=3)).fit(frame(spark, matrix()), 3, "id")
    with pytest.raises(ValueError, match="opt"):
        EncoderConfig(opt="rmsprop")


@pytest.mark.parametrize(
    "rows,label,match",
    [
        ([(1, [0], [1.0], 0), (1, [1], [1.0], 0)], "label", "ids repeat"),
        ([(None, [0], [1.0], 0)], "label", "ids are null"),
        ([(1, [0, 1], [1.0], 0)], "label", "differ in length"),
        ([(1, [0], None, 0)], "label", "differ in length"),
        ([(1, [9], [1.0], 0)], "label", "term index"),
        ([(1, [0], [1.0], None)], "label", "without a label"),
    ],
)
def test_input_checks(spark, rows, label, match):
    frame = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, label long")
    config = EncoderConfig(compress_factor=2, num_epochs=1)
    with pytest.raises(ValueError, match=match):
        DenoisingEncoder(config).fit(frame, 4, "id", label)


def test_epochs_and_history_go_on_after_a_resume(spark):
    rows = [(i, [i % 4], [1.0]) for i in range(12)]
    frame = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>")
    config = EncoderConfig(
        compress_factor=2, num_epochs=2, batch_size=6, verbose_step=1, triplet_strategy="none", opt="momentum"
    )
    first = DenoisingEncoder(config).fit(frame, 4, "id")
    again = DenoisingEncoder(config).fit(frame, 4, "id", resume_from=first)
    assert sorted(r.epoch for r in again.metrics.collect()) == [1, 2, 3, 4]
    whole = DenoisingEncoder(EncoderConfig(**{**config.params(), "num_epochs": 4})).fit(frame, 4, "id")
    assert np.allclose(again.params().w, whole.params().w)


@pytest.mark.parametrize("limit", [1 << 30, 1])
def test_a_fit_that_was_killed_goes_on(spark, tmp_path, monkeypatch, limit):
    """Killed in its second epoch, started again: the weights and metrics of a fit that was not."""
    from kinfold.encoder import training

    df = frame(spark, matrix(9))
    settings = dict(compress_factor=3, num_epochs=2, batch_size=20, triplet_strategy="none", opt="momentum", verbose_step=2)
    config = EncoderConfig(**settings, max_parameter_bytes=limit, block_bytes=8 * K * 5)
    whole = DenoisingEncoder(config).fit(df, V, "id")
    batch_of, calls = training._batch_of, []

    def killed(prepared, b):
        calls.append(b)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return batch_of(prepared, b)

    monkeypatch.setattr(training, "_batch_of", killed)
    with pytest.raises(RuntimeError, match="killed"):
        DenoisingEncoder(config).fit(df, V, "id", recover=str(tmp_path / "fit"))
    again = DenoisingEncoder(config).fit(df, V, "id", recover=str(tmp_path / "fit"))
    assert len(calls) == 3 and again.steps == whole.steps == 2  # the first epoch was not repeated
    a, b = ({r.term_id: r.w for r in m.weights.collect()} for m in (whole, again))
    assert all(np.allclose(a[t], b[t]) for t in a) and a.keys() == b.keys()
    assert [tuple(r) for r in again.metrics.collect()] == [tuple(r) for r in whole.metrics.collect()]


@pytest.mark.parametrize("strategy", ["batch_all", "batch_hard"])
def test_validation_in_batches_is_the_mean_of_theirs(spark, strategy):
    df = frame(spark, matrix(3), np.arange(N) % 3)
    settings = dict(compress_factor=3, num_epochs=1, batch_size=20, triplet_strategy=strategy, verbose_step=1)
    found = DenoisingEncoder(EncoderConfig(**settings, validation_batch=10)).fit(df, V, "id", "label", valid=df)
    got = found.metrics.where("split = 'validate'").first()
    placed = assign_batches(df, "id", 10).select("id", "batch_id")
    want = []
    for b in (0, 1):
        part = df.join(placed.where(F.col("batch_id") == b), "id").drop("batch_id")
        alone = DenoisingEncoder(EncoderConfig(**settings)).fit(df, V, "id", "label", valid=part)
        want.append(alone.metrics.where("split = 'validate'").first())
    for name in ("cost", "autoencoder", "triplet", "fraction", "number"):
        assert got[name] == pytest.approx((want[0][name] + want[1][name]) / 2)


def wide_rows(n, v):
    """Sparse rows with few of many terms, some of them empty or with a repeated term, whose last value counts."""
    rng = np.random.default_rng(5)
    idx = [np.sort(rng.choice(v, k, replace=False)).tolist() for k in rng.integers(0, 6, n)]
    idx[1], idx[2] = [], [7, 3, 7]
    val = [rng.choice([0.0, 0.5, 1.0, 2.0], len(i)).tolist() for i in idx]
    x = np.zeros((n, v))
    for row, i, w in zip(x, idx, val):
        for at, value in zip(i, w):
            row[at] = value
    return x, Rows(pa.table({"idx": pa.array(idx, pa.list_(pa.int32())), "val": pa.array(val, pa.list_(pa.float64()))}))


def test_sparse_rows_are_not_made_dense(monkeypatch):
    """Cross-entropy with a logistic reconstruction takes the entries of the rows alone, with the same results."""
    n, v = 40, 600
    rng = np.random.default_rng(6)
    x, rows = wide_rows(n, v)
    params = M.Params(rng.normal(size=(v, K)), rng.normal(size=K), rng.normal(size=v) * 3)
    weight = rng.random(n)
    a = x @ params.w + params.bh
    h = M.sigmoid(a) - M.sigmoid(params.bh)
    d = M.sigmoid(h @ params.w.T + params.bv)
    losses, slope = M.loss_and_slope(x, d, "cross_entropy")
    dz = slope * weight[:, None] * d * (1 - d)
    dh = dz @ params.w
    f, fb = M.sigmoid(a), M.sigmoid(params.bh)
    da = dh * f * (1 - f)

    def refuse(*args):
        raise AssertionError("rows are made dense")

    monkeypatch.setattr(Rows, "densify", refuse)
    grad = M.Gradient(params)
    found = M.reconstruct(params, grad, rows, rows, 0, n, weight, None, "sigmoid", "sigmoid", "cross_entropy")
    np.testing.assert_allclose(found, losses, rtol=1e-12)
    np.testing.assert_allclose(M.row_losses(params, rows, rows, "sigmoid", "sigmoid", "cross_entropy"), losses, rtol=1e-12)
    np.testing.assert_allclose(grad.w, dz.T @ h + x.T @ da, atol=1e-10)
    np.testing.assert_allclose(grad.bv, dz.sum(0), atol=1e-10)
    np.testing.assert_allclose(grad.bh, da.sum(0) - fb * (1 - fb) * dh.sum(0), atol=1e-10)


def test_an_epoch_has_files_for_all_tasks(spark):
    """One batch is dealt to as many files as there are tasks, not to eight."""
    x = np.ones((400, 3))
    rows = frame(spark, x).withColumn("number", F.col("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        config = EncoderConfig(batch_size=400, triplet_strategy="none")
        stored = DenoisingEncoder(config)._epoch_rows(rows, 1, 400, 1)
        assert stored.count() == 400 and len(stored.inputFiles()) == 32
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_products_by_join_are_added_in_the_tasks(spark):
    """No entry is exploded into components, rows may have repeated or string ids, and few Arrow records fit a batch."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((30, 40)) < 0.4, rng.normal(size=(30, 40)), 0.0)
    x[4] = 0.0
    config = EncoderConfig(compress_factor=4)
    model = EncoderModel.initial(spark, config, 40)
    df = frame(spark, x).select(F.concat(F.lit("d"), F.col("id")).alias("id"), "idx", "val")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        coded = model.transform_by_join(df, "id")
        assert "posexplode" not in coded._jdf.queryExecution().optimizedPlan().toString()
        found = {r.id: r.embedding for r in coded.collect()}
        twice = model.transform_by_join(df.unionByName(df), "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {r.id: r.embedding for r in model.transform(df, "id").collect()}
    assert found.keys() == expected.keys() and len(twice) == 60
    for key, code in expected.items():
        np.testing.assert_allclose(found[key], code, atol=1e-12)
    params = model.params()
    for r in twice:  # entries of equal ids are added up
        a = 2 * x[int(r.id[1:])] @ params.w + params.bh
        np.testing.assert_allclose(r.embedding, M.sigmoid(a) - M.sigmoid(params.bh), atol=1e-12)


def test_parameters_beyond_the_limit_are_joined_by_component(spark):
    x = matrix()
    model = EncoderModel.initial(spark, EncoderConfig(compress_factor=3), V)
    model.params()
    model.max_broadcast = 1
    found = {r.id: r.embedding for r in model.transform_by_join(frame(spark, x), "id").collect()}
    model.max_broadcast = 1 << 30
    for r in model.transform(frame(spark, x), "id").collect():
        np.testing.assert_allclose(found[r.id], r.embedding, atol=1e-12)
