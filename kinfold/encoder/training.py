"""Data-parallel training of the tied-weight denoising encoder.

Each step runs on the rows of one batch, wherever they are: tasks compute
partial gradients, Spark adds them up by block of terms, and the driver, which
holds nothing but the parameters, applies the update. Parameters above
``max_parameter_bytes`` stay a table of blocks that no process holds whole; see
``blocked``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder import math as M
from kinfold.encoder.blocked import BlockedParameters
from kinfold.encoder.model import EncoderModel
from kinfold.functions.vectors import EPS
from kinfold.operators import triplets as T
from kinfold.operators.articles import require
from kinfold.operators.batches import assign_batches, rows_per_batch
from kinfold.operators.blocks import Rows, tasks_of
from kinfold.operators.noise import corrupt
from kinfold.operators.ordering import numbered
from kinfold.operators.vectorize import matrix_extremes
from kinfold.session import discard, exists, materialize, remove, scratch, ship

TERM_BLOCK = 1024  # terms whose gradient travels as one row
_GROUPS = 1000  # folders of an epoch's rows, by batch
_FILES = 8  # files of a batch, at least
_FAN_IN = 64  # partial gradients of a block that one task adds up first
_SPLIT = 4  # a batch is cut into up to this many tiles, so that its triplets occupy many cores
_MIN_TILE = 128
_GRAD_SCHEMA = "block int, data array<double>"
_ROLES = ("org", "pos", "neg")


def _partial_rows(grad: M.Gradient, stats: list[float]) -> Iterator[pa.RecordBatch]:
    """Partial sums of one task: a row per term block, and one for bh and stats."""

    def row(block: int, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int32()),
                "data": pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data, pa.float64())),
            }
        )

    for b, s in enumerate(range(0, len(grad.w), TERM_BLOCK)):
        part = slice(s, s + TERM_BLOCK)
        yield row(b, np.concatenate([grad.w[part].ravel(), grad.bv[part]]))
    yield row(-1, np.concatenate([grad.bh, np.array(stats, dtype=float)]))


def _add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the arrays of one block, holding one batch of them at a time."""
    block, total = None, None
    for part in parts:
        if part.num_rows:
            rows = part.column("data").flatten().to_numpy().reshape(part.num_rows, -1).sum(0)
            block, total = part.column("block").slice(0, 1), rows if total is None else total + rows
    if total is not None:
        ends = pa.array([0, len(total)], pa.int32())
        yield pa.RecordBatch.from_arrays([block, pa.ListArray.from_arrays(ends, pa.array(total))], ["block", "data"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the numbers and gradients of each id; rows come sorted by id, and one id may go on in the next batch."""

    def out(ids: np.ndarray, values: np.ndarray, n: int) -> pa.RecordBatch:
        columns = [pa.array(ids)]
        for part in (values[:, :n], values[:, n:]):
            ends = pa.array(np.arange(len(ids) + 1) * part.shape[1], pa.int32())
            columns.append(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part).ravel())))
        return pa.RecordBatch.from_arrays(columns, ["id", "sums", "grad"])

    held, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy()
        parts = [batch.column(c).flatten().to_numpy().reshape(len(ids), -1) for c in ("sums", "grad")]
        n, values = parts[0].shape[1], np.concatenate(parts, axis=1)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ids, values = ids[starts], np.add.reduceat(values, starts, axis=0)
        if held is not None:
            if held[0][0] == ids[0]:
                values[0] += held[1][0]
            else:
                yield out(*held, n)
        if len(ids) > 1:
            yield out(ids[:-1], values[:-1], n)
        held = ids[-1:], values[-1:]
    if held is not None:
        yield out(*held, n)


def _summed(partials: DataFrame, params: M.Params) -> tuple[M.Gradient, np.ndarray]:
    """Gradient and stats of all tasks; its size is that of the parameters."""
    some = partials.withColumn("some", F.floor(F.spark_partition_id() / _FAN_IN))
    some = some.groupBy("block", "some").applyInArrow(_add_up, _GRAD_SCHEMA)
    table = some.groupBy("block").applyInArrow(_add_up, _GRAD_SCHEMA).toArrow()
    grad, stats = M.Gradient(params), np.zeros(0)
    k = params.w.shape[1]
    for block, data in zip(table.column("block").to_pylist(), table.column("data")):
        values = np.asarray(data.values.to_numpy())
        if block < 0:
            grad.bh, stats = values[:k].copy(), values[k:].copy()
            continue
        s = block * TERM_BLOCK
        n = min(TERM_BLOCK, params.n_features - s)
        grad.w[s : s + n] = values[: n * k].reshape(n, k)
        grad.bv[s : s + n] = values[n * k :]
    return grad, stats


@dataclass
class _Step:
    """What one batch reports: averages over batches make the epoch metrics."""

    cost: float
    autoencoder: float
    triplet: float | None = None
    fraction: float | None = None
    number: float | None = None


def input_checks(rows: DataFrame, n_features: int, suffixes: tuple[str, ...] = ("",)) -> dict[str, Column]:
    """Ids are there and different, each row has its label, indices and values match and lie in range; named by their failure."""
    checks = {
        "ids are null": F.count(F.when(F.col("id").isNull(), 1)) == 0,
        "ids repeat": F.count("id") == F.count_distinct("id"),
    }
    if "label" in rows.columns:
        checks["rows without a label"] = F.count(F.when(F.col("label").isNull(), 1)) == 0
    for s in suffixes:
        idx, val = F.col(f"idx{s}"), F.col(f"val{s}")
        whole = idx.isNotNull() & val.isNotNull() & (F.size(idx) == F.size(val))
        checks[f"idx{s} and val{s} differ in length"] = F.count(F.when(~whole, 1)) == 0
        low, high = F.min(F.array_min(idx)), F.max(F.array_max(idx))
        checks[f"idx{s}: term index outside 0..{n_features - 1}"] = (low >= 0) & (high < n_features)
    return checks


class DenoisingEncoder:
    """Estimator: ``fit`` with online triplets or none, ``fit_triplets`` with given ones."""

    def __init__(self, config: EncoderConfig | None = None):
        self.config = config or EncoderConfig()

    # -- entry points -----------------------------------------------------

    def fit(
        self,
        features: DataFrame,
        n_features: int,
        id_col: str = "article_id",
        label: str | None = None,
        valid: DataFrame | None = None,
        resume_from: EncoderModel | None = None,
        recover: str | None = None,
    ) -> EncoderModel:
        """Packed rows ``(id, idx, val[, label])`` to a fitted model.

        With a folder ``recover`` each epoch ends with the parameters, slots and
        metrics written there; a fit that is started again with the same folder,
        rows and settings goes on after the last epoch that is complete.
        """
        c = self.config
        if c.triplet_strategy != "none" and label is None:
            raise ValueError("a triplet strategy needs labels")
        rows = numbered(self._named(features, id_col, label), "number", "train")
        valid = None if valid is None else self._validation(self._named(valid, id_col, label))
        self._check_rows(rows, n_features, ("",))
        return self._train(rows, valid, n_features, ("",), self._online_step, self._online_cost, resume_from, recover)

    def fit_triplets(
        self,
        triplets: DataFrame,
        n_features: int,
        id_col: str = "article_id",
        valid: DataFrame | None = None,
        resume_from: EncoderModel | None = None,
        recover: str | None = None,
    ) -> EncoderModel:
        """Rows ``(id, idx_r, val_r)`` for r in org, pos, neg to a fitted model; ``recover`` as in ``fit``."""

        def named(df: DataFrame) -> DataFrame:
            return df.select(
                F.col(id_col).cast("bigint").alias("id"),
                *[F.col(f"{v}_{r}").alias(f"{v}_{r}") for r in _ROLES for v in ("idx", "val")],
            )

        rows = numbered(named(triplets), "number", "train")
        require(
            rows,
            {
                "positives and negatives are the same": F.max(
                    (~F.col("idx_pos").eqNullSafe(F.col("idx_neg")) | ~F.col("val_pos").eqNullSafe(F.col("val_neg"))).cast("int")
                ) == 1
            },
        )
        valid = None if valid is None else materialize(named(valid), "valid")
        suffixes = tuple(f"_{r}" for r in _ROLES)
        self._check_rows(rows, n_features, suffixes)
        return self._train(rows, valid, n_features, suffixes, self._explicit_step, self._explicit_cost, resume_from, recover)

    # -- shared loop ------------------------------------------------------

    @staticmethod
    def _named(df: DataFrame, id_col: str, label: str | None) -> DataFrame:
        lab = F.lit(0).cast("bigint") if label is None else F.col(label).cast("bigint")
        return df.select(F.col(id_col).cast("bigint").alias("id"), lab.alias("label"), "idx", "val")

    @staticmethod
    def _check_rows(rows: DataFrame, n_features: int, suffixes: tuple[str, ...]) -> None:
        require(rows, input_checks(rows, n_features, suffixes))

    def _validation(self, rows: DataFrame) -> DataFrame:
        """Validation rows with their ``batch_id``: one batch, or batches of ``validation_batch`` rows."""
        size = self.config.validation_batch
        if size is None:
            return materialize(rows.withColumn("batch_id", F.lit(0).cast("bigint")), "valid")
        return materialize(assign_batches(rows, "id", size, self.config.seed), "valid")

    def _train(self, rows, valid, n_features, suffixes, step, cost, resume_from, recover) -> EncoderModel:
        c, spark = self.config, rows.sparkSession
        ship(spark)
        found = None if recover is None else _last_epoch(spark, recover, c)
        if found is not None:
            resume_from = found[0]
        model = resume_from or EncoderModel.initial(spark, c, n_features, method=c.hash_method)
        if model.n_features != n_features:
            raise ValueError(f"the model has {model.n_features} features, the data {n_features}")
        held = None
        if model.parameter_bytes > c.max_parameter_bytes:
            held = BlockedParameters(spark, c, model, suffixes != ("",), c.block_bytes)
        else:
            params = model.params()
            updater = M.Updater(c.opt, c.learning_rate, c.momentum)
            if resume_from is not None:
                updater.steps = model.steps
                updater.slots = _slots_from_table(model.slots, updater, n_features)
        n_rows = rows.count()
        size = rows_per_batch(c.batch_size, n_rows)
        n_batches = -(-n_rows // size)
        extremes = {s: self._extremes(rows, s, n_features) for s in suffixes}
        metrics: list[tuple] = []
        # A resumed run goes on with the epochs and the history of the model.
        # Read now, a few rows per epoch: the folder of the earlier model may be replaced.
        past = [] if resume_from is None or model.metrics is None else _rows_of_metrics(model.metrics)
        done_before = max((row[0] for row in past), default=0)
        last = done_before + c.num_epochs
        if found is not None:
            done_before, last = found[1:]
        for epoch in range(done_before + 1, last + 1):
            prepared = self._epoch_rows(rows, epoch, n_rows, n_batches)
            done: list[_Step] = []
            for b in range(n_batches):
                batch = _batch_of(prepared, b)
                for s in suffixes:  # draws are hashes of the ids, so they need not be stored
                    batch = _with_corrupted(batch, s, c, n_features, epoch, extremes[s])
                if held is not None:
                    done.append(self._blocked_step(held, batch, size, suffixes))
                    continue
                grad, report = step(spark, batch, params, size)
                params = updater.apply(params, grad)
                done.append(report)
            discard(prepared)
            if epoch % c.verbose_step == 0 or epoch == last:
                metrics.append((epoch, "train", *_mean(done)))
                if valid is not None:
                    report = cost(spark, valid, params) if held is None else self._blocked_cost(held, valid, suffixes)
                    metrics.append((epoch, "validate", *_mean([report])))
            if recover is not None:
                if held is None:
                    now = _fitted(spark, c, params, updater, metrics, n_features, past)
                else:
                    now = _fitted_blocks(spark, c, held, metrics, past)
                _commit_epoch(now, recover, epoch, last)
                discard(now.weights, now.slots)
        discard(rows, valid)
        if held is not None:
            model = _fitted_blocks(spark, c, held, metrics, past)
            discard(held.blocks)
            return model
        return _fitted(spark, c, params, updater, metrics, n_features, past)

    def _blocked_step(self, held: BlockedParameters, batch: DataFrame, size: int, suffixes: tuple[str, ...]) -> _Step:
        explicit = suffixes != ("",)
        online = not explicit and self.config.triplet_strategy != "none"
        triplets = (lambda codes: self._triplet_rows(codes, size)) if online else None
        loss, weight, triplet, n, *sums = held.step(batch, size, suffixes, triplets)
        if explicit:
            return self._explicit_report(np.array([loss, 0.0, 0.0, triplet, n]))
        return self._report(loss / (weight + EPS), *sums, n)

    def _blocked_cost(self, held: BlockedParameters, rows: DataFrame, suffixes: tuple[str, ...]) -> _Step:
        n_rows = rows.count()
        for s in suffixes:  # without corruption
            rows = rows.withColumn(f"idx_c{s}", F.col(f"idx{s}")).withColumn(f"val_c{s}", F.col(f"val{s}"))
        if suffixes != ("",):
            loss, _, triplet, n = held.explicit_cost(rows, n_rows, suffixes)
            return self._explicit_report(np.array([loss, 0.0, 0.0, triplet, n]))
        losses, codes = held.losses(rows, n_rows, self.config.loss_func)
        return self._cost_of(losses, codes.drop("batch_id").join(rows.select("id", "batch_id"), "id"))

    def _extremes(self, rows: DataFrame, suffix: str, n_features: int):
        if self.config.corr_type != "salt_and_pepper":
            return None
        packed = rows.select(F.col(f"idx{suffix}").alias("idx"), F.col(f"val{suffix}").alias("val"))
        found = matrix_extremes(packed, n_features).first()
        return found["min_value"], found["max_value"]

    def _epoch_rows(self, rows: DataFrame, epoch: int, n_rows: int, n_batches: int) -> DataFrame:
        """The clean rows in folders by their batch of this epoch, which a permutation of their numbers names.

        A folder has enough files for the tasks, since a step on a few large ones leaves cores idle.
        """
        c, tasks = self.config, tasks_of(rows.sparkSession)
        files = max(_FILES, -(-tasks // n_batches))
        placed = assign_batches(rows, "id", c.batch_size, c.seed, epoch, n_rows=n_rows, number="number").drop("number")
        group = F.pmod(F.col("batch_id"), F.lit(_GROUPS)).cast("int")
        part = group * F.lit(files) + F.pmod(F.xxhash64("id"), F.lit(files)).cast("int")
        grouped = placed.withColumn("batch_group", group).repartitionById(tasks, F.pmod(part, F.lit(tasks)))
        return materialize(grouped, "epoch", ["batch_group"])

    # -- online triplets --------------------------------------------------

    def _codes(self, batch: DataFrame, shared) -> DataFrame:
        """``(batch_id, id, label, encode)`` of the corrupted input."""
        act = self.config.enc_act_func

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                rows = Rows(pa.Table.from_batches([part]))
                h = M.encode(shared.value, rows, act)
                ends = pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("batch_id"),
                        part.column("id"),
                        part.column("label"),
                        pa.ListArray.from_arrays(ends, pa.array(h.ravel())),
                    ],
                    ["batch_id", "id", "label", "encode"],
                )

        chosen = batch.select("batch_id", "id", "label", F.col("idx_c").alias("idx"), F.col("val_c").alias("val"))
        return chosen.mapInArrow(run, "batch_id bigint, id bigint, label bigint, encode array<double>")

    def _triplet_rows(self, codes: DataFrame, batch_rows: int) -> tuple[DataFrame, float]:
        """``(id, weight, loss, active, valid, grad)`` per row, and the factor of ``grad``.

        Of batch-all every triplet is used by three rows, so the total weight is
        three times their number and the factor is known beforehand; batch-hard
        totals are added up first, from stored rows.
        """
        c = self.config
        with scratch(codes.sparkSession) as keep:
            codes = materialize(codes, "codes")
            if c.triplet_strategy == "batch_all":
                tile = min(c.tile_rows, T.TILE_ROWS, max(-(-batch_rows // _SPLIT), _MIN_TILE))
                parts = T.batch_all_rows(codes, tile_rows=tile)
                parts = parts.withColumnRenamed("w_valid", "weight").withColumnRenamed("loss_valid", "loss")
            else:
                parts = T.batch_hard_rows(codes, c.hard_mode, c.tile_rows)
            numbers = ["weight", "loss", "active", "valid"]
            parts = parts.select("id", F.array(*numbers).alias("sums"), "grad")
            dealt = parts.repartition("id").sortWithinPartitions("id")
            rows = dealt.mapInArrow(_add_rows, "id bigint, sums array<double>, grad array<double>")
            sums = [F.col("sums")[i].alias(n) for i, n in enumerate(numbers)]
            rows = keep(materialize(rows.select("id", *sums, "grad"), "triplets"))
        if c.triplet_strategy == "batch_all":
            return rows, 3.0 * c.alpha
        totals = rows.agg(F.sum("weight").alias("weight"), F.sum("active").alias("used")).first()
        return rows, c.alpha * (totals["weight"] + EPS) / (totals["used"] + EPS)

    def _online_step(self, spark: SparkSession, batch: DataFrame, params: M.Params, batch_rows: int):
        c = self.config
        shared = spark.sparkContext.broadcast(params)
        try:
            inputs = batch.select("id", "idx", "val", "idx_c", "val_c")
            if c.triplet_strategy == "none":
                none = {"weight": 1.0, "loss": 0.0, "active": 0.0, "valid": 0.0}
                rows, slope = inputs, 0.0
                for name, value in none.items():
                    rows = rows.withColumn(name, F.lit(value))
                rows = rows.withColumn("grad", F.lit(None).cast("array<double>"))
            else:
                found, slope = self._triplet_rows(self._codes(batch, shared), batch_rows)
                rows = inputs.join(found, "id")
            partials = rows.drop("id").mapInArrow(self._backward(shared, slope), _GRAD_SCHEMA)
            grad, stats = _summed(partials, params)
            scale = 1.0 / (stats[1] + EPS)
            _scale(grad, scale)
            return grad, self._report(stats[0] * scale, *stats[2:])
        finally:
            shared.destroy()

    def _report(self, ae: float, loss: float, active: float, valid: float, n: float) -> _Step:
        if self.config.triplet_strategy == "none":
            return _Step(ae, ae)
        by_all = self.config.triplet_strategy == "batch_all"
        triplet = loss / ((valid if by_all else active) + EPS)
        fraction = active / (valid + EPS) if by_all else active / n
        return _Step(ae + self.config.alpha * triplet, ae, triplet, fraction, active)

    def _backward(self, shared, slope: float):
        """Partial gradient of ``sum(weight * loss) + slope * triplet sum`` per task."""
        c = self.config

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            params, grad = shared.value, None
            stats = np.zeros(6)  # weighted loss, weight, triplet loss, active, valid, rows
            for part in batches:
                if part.num_rows == 0:
                    continue
                grad = grad or M.Gradient(params)
                table = pa.Table.from_batches([part])
                clean = Rows(table.select(["idx", "val"]))
                noisy = Rows(table.select(["idx_c", "val_c"]).rename_columns(["idx", "val"]))
                weight = table.column("weight").to_numpy()
                slopes = None
                if table.column("grad").null_count == 0:
                    flat = table.column("grad").combine_chunks().flatten().to_numpy()
                    slopes = flat.reshape(table.num_rows, -1) * slope
                for s in range(0, clean.n, M.STRIP):
                    e = min(s + M.STRIP, clean.n)
                    extra = None if slopes is None else slopes[s:e]
                    losses = M.reconstruct(
                        params, grad, clean, noisy, s, e, weight[s:e], extra, c.enc_act_func, c.dec_act_func, c.loss_func
                    )
                    stats[0] += losses @ weight[s:e]
                stats[1] += weight.sum()
                stats[2:5] += [table.column(n).to_numpy().sum() for n in ("loss", "active", "valid")]
                stats[5] += table.num_rows
            if grad is not None:
                yield from _partial_rows(grad, stats.tolist())

        return run

    def _online_cost(self, spark: SparkSession, rows: DataFrame, params: M.Params) -> _Step:
        """Cost of clean rows in their batches, without a gradient."""
        c = self.config
        model = _model_of(spark, c, params)
        losses = model.reconstruction_losses(rows, "id", c.loss_func)
        codes = model.transform(rows, "id", ["batch_id", "label"]).withColumnRenamed("embedding", "encode")
        return self._cost_of(losses, codes)

    def _cost_of(self, losses: DataFrame, codes: DataFrame) -> _Step:
        """Cost from the rows' losses ``(id, loss)`` and their codes; the mean over batches, as in training."""
        c = self.config
        if c.triplet_strategy == "none":
            cost = losses.agg((F.sum("loss") / (F.count(F.lit(1)) + F.lit(EPS))).alias("c")).first()["c"]
            return _Step(cost, cost)
        with scratch(codes.sparkSession):
            codes = materialize(codes, "codes")
            if c.triplet_strategy == "batch_all":
                stats = T.batch_all(codes, tile_rows=min(c.tile_rows, T.TILE_ROWS))
                weights = T.batch_all_weights(codes)
            else:
                stats = T.batch_hard(codes, c.hard_mode, c.tile_rows)
                weights = T.batch_hard_weights(codes, c.hard_mode, c.tile_rows)
            ae = losses.join(weights, "id").groupBy("batch_id").agg(
                (F.sum(F.col("loss") * F.col("weight")) / (F.sum("weight") + F.lit(EPS))).alias("ae")
            )
            each = stats.select("batch_id", F.col("loss").alias("triplet"), "fraction", "number").join(ae, "batch_id")
            m = each.agg(*[F.avg(n).alias(n) for n in ("ae", "triplet", "fraction", "number")]).first()
        return _Step(m["ae"] + c.alpha * m["triplet"], m["ae"], m["triplet"], m["fraction"], m["number"])

    # -- given triplets ---------------------------------------------------

    def _explicit_kernel(self, shared, noisy: bool, with_grad: bool):
        c = self.config
        f = M.ACT[c.enc_act_func][0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            params, grad = shared.value, None
            sums = np.zeros(5)  # losses of the three roles, triplet loss, rows
            for part in batches:
                if part.num_rows == 0:
                    continue
                grad = grad or M.Gradient(params)
                table = pa.Table.from_batches([part])

                def role(r: str, corrupted: bool) -> Rows:
                    mark = "_c" if corrupted else ""
                    return Rows(table.select([f"idx{mark}_{r}", f"val{mark}_{r}"]).rename_columns(["idx", "val"]))

                clean = {r: role(r, False) for r in _ROLES}
                given = {r: role(r, noisy) for r in _ROLES}
                for s in range(0, table.num_rows, M.STRIP):
                    e = min(s + M.STRIP, table.num_rows)
                    h = {r: f(M.pre_activation(params, given[r], s, e)[0]) - f(params.bh) for r in _ROLES}
                    gap = (h["org"] * (h["neg"] - h["pos"])).sum(1)
                    sums[3] += M.softplus(gap).sum()
                    sums[4] += e - s
                    if not with_grad:
                        for k, r in enumerate(_ROLES):
                            sums[k] += M.strip_losses(params, h[r], clean[r], s, e, c.dec_act_func, c.loss_func).sum()
                        continue
                    g = (c.alpha * M.sigmoid(gap))[:, None]
                    slope = {"org": g * (h["neg"] - h["pos"]), "pos": -g * h["org"], "neg": g * h["org"]}
                    one = np.ones(e - s)
                    for k, r in enumerate(_ROLES):
                        sums[k] += M.reconstruct(
                            params, grad, clean[r], given[r], s, e, one, slope[r],
                            c.enc_act_func, c.dec_act_func, c.loss_func,
                        ).sum()
            if grad is not None:
                if with_grad:
                    yield from _partial_rows(grad, sums.tolist())
                else:
                    data = pa.array([sums.tolist()], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), data], ["block", "data"])

        return run

    def _explicit_report(self, sums: np.ndarray) -> _Step:
        n = sums[4]
        ae, triplet = sums[:3].sum() / (n + EPS), sums[3] / n
        return _Step(ae + self.config.alpha * triplet, ae, triplet)

    def _explicit_step(self, spark: SparkSession, batch: DataFrame, params: M.Params, batch_rows: int):
        shared = spark.sparkContext.broadcast(params)
        try:
            rows = batch.drop("id", "batch_id", "batch_group", "number")
            partials = rows.mapInArrow(self._explicit_kernel(shared, True, True), _GRAD_SCHEMA)
            grad, sums = _summed(partials, params)
            _scale(grad, 1.0 / sums[4])
            return grad, self._explicit_report(sums)
        finally:
            shared.destroy()

    def _explicit_cost(self, spark: SparkSession, rows: DataFrame, params: M.Params) -> _Step:
        shared = spark.sparkContext.broadcast(params)
        try:
            partials = rows.drop("id").mapInArrow(self._explicit_kernel(shared, False, False), _GRAD_SCHEMA)
            each = partials.select(F.posexplode("data").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
            sums = np.zeros(5)
            for row in each.collect():  # five totals
                sums[row["k"]] = row["v"]
            return self._explicit_report(sums)
        finally:
            shared.destroy()


def _with_corrupted(rows: DataFrame, s: str, c: EncoderConfig, n_features: int, epoch: int, extremes) -> DataFrame:
    """Rows with the corrupted copy ``idx_c<s>``, ``val_c<s>`` next to the clean input."""
    held = rows.withColumn("_idx", F.col(f"idx{s}")).withColumn("_val", F.col(f"val{s}"))
    work = held.withColumn("idx", F.col("_idx")).withColumn("val", F.col("_val"))
    noisy = corrupt(work, c.corr_type, c.corr_frac, n_features, "id", f"{c.seed}{s}", epoch, c.hash_method, extremes)
    clean = {f"idx{s}": "_idx", f"val{s}": "_val"}
    return noisy.select(
        *[F.col(clean.get(x, x)).alias(x) for x in rows.columns],
        F.col("idx").alias(f"idx_c{s}"),
        F.col("val").alias(f"val_c{s}"),
    )


def _batch_of(prepared: DataFrame, b: int) -> DataFrame:
    """One batch, from the folder of its group."""
    return prepared.filter((F.col("batch_group") == b % _GROUPS) & (F.col("batch_id") == b))


def _scale(grad: M.Gradient, factor: float) -> None:
    grad.w *= factor
    grad.bh *= factor
    grad.bv *= factor


def _mean(steps: list[_Step]) -> tuple:
    def mean(name: str):
        values = [getattr(s, name) for s in steps if getattr(s, name) is not None]
        return float(np.mean(values)) if values else None

    return tuple(mean(n) for n in ("cost", "autoencoder", "triplet", "fraction", "number"))


_METRIC_NAMES = ("epoch", "split", "cost", "autoencoder", "triplet", "fraction", "number")
_METRICS = "epoch int, split string, cost double, autoencoder double, triplet double, fraction double, number double"


def _array_table(spark: SparkSession, w: np.ndarray, bv: np.ndarray) -> DataFrame:
    ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
    table = pa.table(
        {
            "term_id": pa.array(np.arange(len(w)), pa.int32()),
            "w": pa.ListArray.from_arrays(ends, pa.array(w.ravel())),
            "bv": pa.array(bv),
        }
    )
    return spark.createDataFrame(table)


def _model_of(spark: SparkSession, c: EncoderConfig, params: M.Params, **parts) -> EncoderModel:
    bias = spark.createDataFrame([(params.bh.tolist(),)], "bh array<double>")
    model = EncoderModel(
        _array_table(spark, params.w, params.bv), bias, params.n_features, params.w.shape[1],
        c.enc_act_func, c.dec_act_func, max_broadcast=c.max_parameter_bytes, **parts,
    )
    model._params = params
    return model


def _slots_table(spark: SparkSession, updater: M.Updater) -> DataFrame | None:
    """``(slot, term_id, w, bv)``; term -1 carries the slot of the hidden bias."""
    out = None
    for name, slot in updater.slots.items():
        df = _array_table(spark, slot["w"], slot["bv"])
        bias = spark.createDataFrame([(-1, slot["bh"].tolist(), 0.0)], "term_id int, w array<double>, bv double")
        both = df.unionByName(bias).withColumn("slot", F.lit(name))
        out = both if out is None else out.unionByName(both)
    return out


def _slots_from_table(slots: DataFrame | None, updater: M.Updater, n_features: int) -> dict:
    found: dict = {}
    if slots is None:
        return found
    for name in updater.slot_names():
        table = slots.filter(F.col("slot") == name).orderBy("term_id").toArrow()
        if table.num_rows != n_features + 1:
            continue
        w = table.column("w").combine_chunks().flatten().to_numpy().reshape(n_features + 1, -1)
        found[name] = {"bh": w[0].copy(), "w": w[1:].copy(), "bv": table.column("bv").to_numpy()[1:].copy()}
    return found


def _fitted_blocks(
    spark: SparkSession, c: EncoderConfig, held: BlockedParameters, metrics: list, past: list
) -> EncoderModel:
    weights, slots, bias = held.tables()
    model = EncoderModel(
        weights, bias, held.layout.n_features, held.layout.k, c.enc_act_func, c.dec_act_func,
        slots=slots, metrics=spark.createDataFrame(past + metrics, _METRICS), steps=held.updater.steps, max_broadcast=c.max_parameter_bytes,
    )
    return model


def _commit_epoch(model: EncoderModel, path: str, epoch: int, last: int) -> None:
    """Write a model, then the row that says it is complete; then the one before it is not needed."""
    spark = model.weights.sparkSession
    model.save(f"{path}/epoch-{epoch}", mode="overwrite")
    done = spark.createDataFrame([(epoch, last)], "epoch int, last int").coalesce(1)
    done.write.mode("append").parquet(f"{path}/done")
    remove(spark, f"{path}/epoch-{epoch - 1}")


def _last_epoch(spark: SparkSession, path: str, c: EncoderConfig) -> tuple[EncoderModel, int, int] | None:
    """The model of the last complete epoch under ``path``, its number, and that of the fit's last epoch."""
    if not exists(spark, f"{path}/done"):
        return None
    epoch, last = spark.read.parquet(f"{path}/done").agg(F.max(F.struct("epoch", "last")).alias("m")).select("m.*").first()
    return EncoderModel.load(spark, f"{path}/epoch-{epoch}", c.max_parameter_bytes), epoch, last


def _rows_of_metrics(metrics: DataFrame) -> list[tuple]:
    return [tuple(r) for r in metrics.select(*_METRIC_NAMES).orderBy("epoch", "split").collect()]


def _fitted(
    spark, c: EncoderConfig, params: M.Params, updater: M.Updater, metrics: list, n_features: int, past: list
) -> EncoderModel:
    """The model with its tables written, so that nothing hangs on the driver."""
    slots = _slots_table(spark, updater)
    history = spark.createDataFrame(past + metrics, _METRICS)
    model = _model_of(
        spark, c, params,
        slots=None if slots is None else materialize(slots, "slots"),
        metrics=history,
        steps=updater.steps,
    )
    model.weights = materialize(model.weights, "weights")
    return model
