"""Training on blocks of parameters against training with parameters on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder import blocked as B
from kinfold.encoder.model import EncoderModel
from kinfold.encoder.training import DenoisingEncoder

N, V, K = 20, 12, 4


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(B, "TILE_ROWS", 6)


def matrix(seed):
    x = (np.random.default_rng(seed).random((N, V)) < 0.35) * np.random.default_rng(seed).uniform(0.2, 1, (N, V))
    x[4] = 0  # a row without a term
    x[:, 7] = 0  # a term without a row
    return x


def frame(spark, x):
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist(), i % 3) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, label long")


def triplets(spark, x):
    rows = []
    for i in range(N):
        row = [i]
        for k in (i, (i + 1) % N, (i + 7) % N):
            row += [np.flatnonzero(x[k]).tolist(), x[k][x[k] != 0].tolist()]
        rows.append(tuple(row))
    cols = "id long, " + ", ".join(f"idx_{r} array<int>, val_{r} array<double>" for r in ("org", "pos", "neg"))
    return spark.createDataFrame(rows, cols)


def both(**settings):
    """The same settings for the driver and for blocks of five terms."""
    plain = EncoderConfig(compress_factor=3, num_epochs=1, batch_size=12, verbose_step=1, learning_rate=0.05, **settings)
    return plain, EncoderConfig(**{**plain.params(), "max_parameter_bytes": 1, "block_bytes": 8 * K * 5})


def same(a, b):
    """Weights, biases, slots, steps and metrics of two models."""
    for x, y in ((a.weights, b.weights), (a.hidden_bias, b.hidden_bias)):
        x, y = (sorted(t.collect(), key=lambda r: r.asDict().get("term_id", 0)) for t in (x, y))
        assert len(x) == len(y)
        for r, s in zip(x, y):
            assert all(np.allclose(r[c], s[c], atol=1e-9, rtol=1e-7) for c in r.asDict())
    assert a.steps == b.steps and (a.slots is None) == (b.slots is None)
    if a.slots is not None:
        x, y = (
            {(r.slot, r.term_id): (r.w, r.bv) for r in m.slots.select("slot", "term_id", "w", "bv").collect()} for m in (a, b)
        )
        assert x.keys() == y.keys() and len(x) == len(a.slots.collect())
        assert all(np.allclose(x[k][0], y[k][0]) and np.allclose(x[k][1], y[k][1]) for k in x)
    x, y = (m.metrics.orderBy("epoch", "split").collect() for m in (a, b))
    assert [r[:2] for r in x] == [r[:2] for r in y]
    for r, s in zip(x, y):
        assert [v is None for v in r] == [v is None for v in s]
        assert [v for v in r[2:] if v is not None] == pytest.approx([v for v in s[2:] if v is not None])


CASES = [
    dict(triplet_strategy="none", opt="adam", loss_func="cross_entropy"),
    dict(triplet_strategy="none", opt="momentum", loss_func="cosine_proximity", enc_act_func="tanh", dec_act_func="none"),
    dict(triplet_strategy="batch_all", opt="ada_grad", loss_func="mean_squared", enc_act_func="none", dec_act_func="tanh"),
    dict(triplet_strategy="batch_hard", opt="gradient_descent", loss_func="cross_entropy", corr_type="salt_and_pepper"),
]


@pytest.mark.parametrize("case", CASES)
def test_fit_equals_the_driver(spark, case):
    df = frame(spark, matrix(1))
    plain, blocks = both(**case)
    a, b = (DenoisingEncoder(c).fit(df, V, "id", "label", valid=df) for c in (plain, blocks))
    same(a, b)


def test_given_triplets_equal_the_driver(spark):
    df = triplets(spark, matrix(2))
    a, b = (DenoisingEncoder(c).fit_triplets(df, V, "id", valid=df) for c in both(opt="adam", alpha=2.0))
    same(a, b)


def test_save_resume_and_losses(spark, tmp_path):
    df = frame(spark, matrix(3))
    plain, blocks = both(triplet_strategy="none", opt="momentum")
    models = [DenoisingEncoder(c).fit(df, V, "id") for c in (plain, blocks)]
    for model, c, name in zip(models, (plain, blocks), "ab"):
        model.save(str(tmp_path / name))
    back = [EncoderModel.load(spark, str(tmp_path / n), max_broadcast=m) for n, m in (("a", 1 << 30), ("b", 1))]
    same(*(DenoisingEncoder(c).fit(df, V, "id", resume_from=m) for c, m in zip((plain, blocks), back)))
    # Parameters stay a table when rows are encoded and decoded, too.
    noisy = df.withColumn("target", F.col("val")).withColumn("val", F.transform("val", lambda v: v * 0.5))
    for loss in ("cross_entropy", "cosine_proximity"):
        x, y = (
            {r.id: r.loss for r in m.reconstruction_losses(noisy, "id", loss, "target").collect()} for m in back
        )
        assert x.keys() == y.keys() and all(x[i] == pytest.approx(y[i]) for i in x)
    with pytest.raises(ValueError, match="exceed"):
        back[1].params()


def test_blocks_are_bounded(spark):
    layout = B.Layout(spark, 10**7, 5000)
    assert layout.terms * layout.k * 8 <= B.BLOCK_BYTES and layout.blocks * layout.terms >= 10**7
    assert layout.tile_rows * layout.k * 8 <= B.TILE_BYTES
    arrays = [np.arange(3), np.ones(0), np.float64([1.5]), np.int32([1, 2, 3])]
    again = B._unpack(B._pack(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, again, strict=True))
