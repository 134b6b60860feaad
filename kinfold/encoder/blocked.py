"""Training with the parameters as a table of term blocks.

For parameters that no single process can hold. W, the visible bias and the
optimizer's slots are cut by term into blocks, a row each of a stored table;
the rows of a batch are cut into tiles, and each tile into a slice per block.
A step is a chain of shuffles between the two views:

1. by block: a slice of the corrupted input times its block of W; by tile: sums
   of these products, the codes;
2. by block: the codes times the block, the reconstruction of these terms, its
   loss and slopes, the block's gradient, and what goes back to the codes;
   by tile: sums of that, with the slopes of the triplets, through the encoder;
3. by block: the gradient from the input's side, all sums, and the update.

A task holds one block and one tile; it streams the tiles past the block. All
rows of the chain have one form, (key, seq, tile, role, kind, data), and come
sorted, parameters first. Only the hidden bias, its slots and the sums for the
metrics are on the driver.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder import math as M
from kinfold.encoder.model import EncoderModel
from kinfold.functions.vectors import EPS, L2_EPS
from kinfold.operators.blocks import lists
from kinfold.session import discard, materialize, ship

BLOCK_BYTES = 8 << 20  # W of one block
TILE_BYTES = 2 << 20  # codes of one tile
TILE_ROWS = 256
_SUMS = 64  # rows of totals that reach the driver

PARAMS, SLICE, CODE, WEIGHT, NORMS, PART, SLOPE, GRADIENT, DELTA, IDS, TOTAL = range(11)
_STREAM = "key bigint, seq int, tile bigint, role int, kind int, data binary"
_NAMES = ["key", "seq", "tile", "role", "kind", "data"]


def _pack(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        parts += [a.dtype.str.encode().ljust(8), np.int64(a.size).tobytes(), a.tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size = np.dtype(data[at : at + 8].decode().strip()), int.from_bytes(data[at + 8 : at + 16], "little")
        out.append(np.frombuffer(data, kind, size, at + 16))
        at += 16 + size * kind.itemsize + -(size * kind.itemsize) % 8
    return out


def _row(key: int, seq: int, tile: int, role: int, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    values = zip((key, seq, tile, role, kind, _pack(*arrays)), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=_NAMES)


def _dense(ptr: np.ndarray, col: np.ndarray, val: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(ptr) - 1, width))
    out[np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), col] = val
    return out


def _stream(rows: DataFrame, make: Callable, schema: str = _STREAM) -> DataFrame:
    """Deal rows by key, sort them, and let ``make(key)`` take each key's rows one by one."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, work = None, None
        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in _NAMES[:-1]]
            data = batch.column("data")
            for i, (key, *where) in enumerate(zip(*fields)):
                if key != current:
                    if work is not None:
                        yield from work.end()
                    current, work = key, make(key)
                yield from work.row(*where, _unpack(data[i].as_py()))
        if work is not None:
            yield from work.end()

    dealt = rows.repartitionById(tasks, F.pmod("key", F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions(*_NAMES[:-1]).mapInArrow(run, schema)


# -- work by block ------------------------------------------------------------


class _ByBlock:
    """Takes a block's parameters, then the pieces of one (tile, role) after another."""

    def __init__(self, key: int):
        self.key, self.at, self.held = key, None, {}

    def row(self, seq: int, tile: int, role: int, kind: int, data: list) -> Iterable[pa.RecordBatch]:
        if seq == 0:
            self.begin(data)
            return
        if self.at != (tile, role):
            yield from self._flush()
            self.at = tile, role
        self.held[kind] = data

    def _flush(self) -> Iterable[pa.RecordBatch]:
        if self.held:
            yield from self.tile(*self.at, self.held)
        self.held = {}

    def end(self) -> Iterable[pa.RecordBatch]:
        yield from self._flush()
        yield from self.done()

    def begin(self, data: list) -> None:
        self.bv = data[1]
        self.w = data[0].reshape(len(self.bv), -1)

    def tile(self, tile: int, role: int, held: dict) -> Iterable[pa.RecordBatch]:
        return ()

    def done(self) -> Iterable[pa.RecordBatch]:
        return ()


class _Products(_ByBlock):
    """A tile's slice of the corrupted input times the block."""

    def tile(self, tile: int, role: int, held: dict) -> Iterable[pa.RecordBatch]:
        ptr, col, val = held[SLICE][3:6]
        if len(col) or self.key == tile % self.parts:  # the first block names every tile
            yield _row(tile, 1, tile, role, PART, (_dense(ptr, col, val, len(self.bv)) @ self.w).ravel())

    def __init__(self, key: int, parts: int):
        super().__init__(key)
        self.parts = parts


class _Norms(_ByBlock):
    """What the cosine of input and reconstruction needs of this block."""

    def __init__(self, key: int, dec: str):
        super().__init__(key)
        self.g = M.ACT[dec][0]

    def tile(self, tile: int, role: int, held: dict) -> Iterable[pa.RecordBatch]:
        ptr, col, val = held[SLICE][:3]
        x = _dense(ptr, col, val, len(self.bv))
        d = self.g(held[CODE][0].reshape(len(x), -1) @ self.w.T + self.bv)
        yield _row(tile, 1, tile, role, PART, np.concatenate([(x * x).sum(1), (d * d).sum(1), (x * d).sum(1)]))


class _Backward(_ByBlock):
    """Reconstruction of the block's terms: losses and slopes by tile, the gradient by block."""

    def __init__(self, key: int, parts: int, dec: str, loss: str, with_grad: bool):
        super().__init__(key)
        self.block, self.loss, self.with_grad = key // parts, loss, with_grad
        self.g, self.dg = M.ACT[dec]

    def begin(self, data: list) -> None:
        super().begin(data)
        self.gw, self.gv = np.zeros_like(self.w), np.zeros_like(self.bv)

    def _loss(self, x: np.ndarray, d: np.ndarray, held: dict) -> tuple[np.ndarray, np.ndarray]:
        if self.loss in ("cross_entropy", "mean_squared"):
            return M.loss_and_slope(x, d, self.loss)
        sx, sd, xd = held[NORMS][0].reshape(3, -1, 1)
        x_size, d_size = np.sqrt(np.maximum(sx, L2_EPS)), np.sqrt(np.maximum(sd, L2_EPS))
        cos = xd / (x_size * d_size)
        slope = -(x / x_size - np.where(sd > L2_EPS, cos * d / d_size, 0.0)) / d_size
        return -cos[:, 0] * (self.block == 0), slope  # the cosine is one number, not a sum over blocks

    def tile(self, tile: int, role: int, held: dict) -> Iterable[pa.RecordBatch]:
        ptr, col, val = held[SLICE][:3]
        x = _dense(ptr, col, val, len(self.bv))
        h = held[CODE][0].reshape(len(x), -1)
        d = self.g(h @ self.w.T + self.bv)
        losses, slope = self._loss(x, d, held)
        back = np.zeros(0)
        if self.with_grad:
            dz = slope * self.dg(d)
            if WEIGHT in held:
                dz = dz * held[WEIGHT][0][:, None]
            self.gw += dz.T @ h
            self.gv += dz.sum(0)
            back = (dz @ self.w).ravel()
        yield _row(tile, 1, tile, role, PART, back, losses)

    def done(self) -> Iterable[pa.RecordBatch]:
        if self.with_grad:
            yield _row(self.block, 1, -1, -1, GRADIENT, self.gw.ravel(), self.gv)


class _FromInput(_ByBlock):
    """The gradient of the block from the side of the input."""

    def __init__(self, key: int, parts: int, terms: int, n_features: int):
        super().__init__(key)
        self.block, self.gw = key // parts, None
        self.width = min(terms, n_features - self.block * terms)

    def tile(self, tile: int, role: int, held: dict) -> Iterable[pa.RecordBatch]:
        ptr, col, val = held[SLICE][3:6]
        x = _dense(ptr, col, val, self.width)
        gw = x.T @ held[DELTA][0].reshape(len(x), -1)
        self.gw = gw if self.gw is None else self.gw + gw
        return ()

    def done(self) -> Iterable[pa.RecordBatch]:
        if self.gw is not None:
            yield _row(self.block, 1, -1, -1, GRADIENT, self.gw.ravel(), np.zeros(self.width))


class _Update(_ByBlock):
    """The sum of a block's gradients, and its parameters and slots after the update."""

    def __init__(self, key: int, c: EncoderConfig, steps: int, scale: float):
        super().__init__(key)
        self.updater = M.Updater(c.opt, c.learning_rate, c.momentum)
        self.updater.steps, self.scale, self.sum = steps, scale, None

    def begin(self, data: list) -> None:
        super().begin(data)
        for name, w, bv in zip(self.updater.slot_names(), data[2::2], data[3::2]):
            self.updater.slots[name] = {"w": w.reshape(self.w.shape), "bv": bv, "bh": np.zeros(0)}

    def row(self, seq: int, tile: int, role: int, kind: int, data: list) -> Iterable[pa.RecordBatch]:
        if seq == 0:
            self.begin(data)
        else:
            self.sum = data if self.sum is None else [a + b for a, b in zip(self.sum, data)]
        return ()

    def done(self) -> Iterable[pa.RecordBatch]:
        old = M.Params(self.w, np.zeros(0), self.bv)
        grad = M.Gradient(old)
        grad.w, grad.bv = self.sum[0].reshape(self.w.shape) * self.scale, self.sum[1] * self.scale
        new = self.updater.apply(old, grad)
        slots = [a.ravel() for s in self.updater.slot_names() for a in map(self.updater.slots[s].get, ("w", "bv"))]
        yield _row(self.key, 0, -1, -1, PARAMS, new.w.ravel(), new.bv, *slots)


# -- work by tile ---------------------------------------------------------------


class _ByTile:
    """Adds up the parts of a tile, by role."""

    def __init__(self, key: int):
        self.tile, self.sums, self.held = key, {}, {}

    def row(self, seq: int, tile: int, role: int, kind: int, data: list) -> Iterable[pa.RecordBatch]:
        if kind == PART:
            old = self.sums.get(role)
            self.sums[role] = data if old is None else [a + b for a, b in zip(old, data)]
        else:
            self.held[kind, role] = data
        return ()


class _Codes(_ByTile):
    def __init__(self, key: int, bh: np.ndarray, enc: str):
        super().__init__(key)
        self.bh, self.f = bh, M.ACT[enc][0]

    def end(self) -> Iterable[pa.RecordBatch]:
        for role, (a,) in sorted(self.sums.items()):
            h = self.f(a.reshape(-1, len(self.bh)) + self.bh) - self.f(self.bh)
            yield _row(self.tile, 1, self.tile, role, CODE, h.ravel())


class _Summed(_ByTile):
    def __init__(self, key: int, kind: int):
        super().__init__(key)
        self.kind = kind

    def end(self) -> Iterable[pa.RecordBatch]:
        for role, data in sorted(self.sums.items()):
            yield _row(self.tile, 1, self.tile, role, self.kind, *data)


class _Totals(_ByTile):
    """One row of sums for many tiles."""

    def row(self, seq: int, tile: int, role: int, kind: int, data: list) -> Iterable[pa.RecordBatch]:
        return super().row(seq, 0, 0, PART, data)

    def end(self) -> Iterable[pa.RecordBatch]:
        yield _row(self.tile, 1, -1, -1, TOTAL, *self.sums[0])


class _ThroughCodes(_ByTile):
    """Slopes by the codes, with those of the triplets, through the encoder's activation."""

    def __init__(self, key: int, bh: np.ndarray, enc: str, explicit: bool, alpha: float):
        super().__init__(key)
        self.bh, (self.f, self.df), self.explicit, self.alpha = bh, M.ACT[enc], explicit, alpha

    def end(self) -> Iterable[pa.RecordBatch]:
        k, fb = len(self.bh), self.f(self.bh)
        h = {role: data[0].reshape(-1, k) for (kind, role), data in self.held.items() if kind == CODE}
        slopes, n, triplet = {}, len(h[0]), 0.0
        if self.explicit:
            gap = (h[0] * (h[2] - h[1])).sum(1)
            triplet = M.softplus(gap).sum()
            s = (self.alpha * M.sigmoid(gap))[:, None]
            slopes = {0: s * (h[2] - h[1]), 1: -s * h[0], 2: s * h[0]}
        elif (SLOPE, 0) in self.held:
            slopes = {0: self.held[SLOPE, 0][0].reshape(n, k)}
        weight = self.held[WEIGHT, 0][0] if (WEIGHT, 0) in self.held else np.ones(n)
        gh, losses = np.zeros(k), 0.0
        for role, (back, loss) in sorted(self.sums.items()):
            dh = back.reshape(n, k) + slopes.get(role, 0.0)
            da = dh * self.df(h[role] + fb)
            gh += da.sum(0) - self.df(fb) * dh.sum(0)
            losses += loss @ weight
            yield _row(self.tile, 1, self.tile, role, DELTA, da.ravel())
        yield _row(self.tile % _SUMS, 1, self.tile, -1, TOTAL, gh, np.array([losses, weight.sum(), triplet, n]))


class _RowCodes(_ByTile):
    """Codes, or losses, a row per id."""

    def __init__(self, key: int, kind: int):
        super().__init__(key)
        self.kind = kind

    def end(self) -> Iterable[pa.RecordBatch]:
        ids, labels = self.held[IDS, 0]
        data = self.held[self.kind, 0][-1].reshape(len(ids), -1)
        if self.kind == CODE:
            ends = pa.array(np.arange(len(ids) + 1) * data.shape[1], pa.int32())
            columns = {
                "batch_id": pa.array(np.zeros(len(ids), np.int64)),
                "id": pa.array(ids),
                "label": pa.array(labels),
                "encode": pa.ListArray.from_arrays(ends, pa.array(data.ravel())),
            }
        else:
            columns = {"id": pa.array(ids), "loss": pa.array(data[:, 0])}
        yield pa.RecordBatch.from_pydict(columns)


# -- the tables -------------------------------------------------------------------


class Layout:
    """How parameters of ``n_features`` x ``k`` are cut."""

    def __init__(self, spark: SparkSession, n_features: int, k: int, block_bytes: int = BLOCK_BYTES):
        self.n_features, self.k = n_features, k
        self.terms = max(1, min(n_features, block_bytes // (8 * k)))
        self.blocks = math.ceil(n_features / self.terms)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        self.tile_rows = max(1, min(TILE_ROWS, TILE_BYTES // (8 * k)))
        self.parts = math.ceil(tasks / self.blocks)  # tasks that share a block's tiles


def _slices(rows: DataFrame, layout: Layout, n_rows: int, suffixes: tuple[str, ...]) -> DataFrame:
    """The rows of a batch in tiles: a slice per (block, tile, role), and each tile's ids and labels."""
    tiles = max(1, math.ceil(n_rows / layout.tile_rows))
    names = [f"{v}{s}" for s in suffixes for v in ("idx", "val", "idx_c", "val_c")]
    label = F.col("label").cast("bigint") if "label" in rows.columns else F.lit(0).cast("bigint")
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile"), "id", label.alias("label"), *names)
    terms, blocks, parts = layout.terms, layout.blocks, layout.parts

    def cut(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
        tile = table.column("tile")[0].as_py()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        out = [_row(tile, 1, tile, 0, IDS, ids, labels)]
        for role, s in enumerate(suffixes):
            of_block: list[list[np.ndarray]] = [[] for _ in range(blocks)]
            for mark in ("", "_c"):
                offsets, idx = lists(table, f"idx{mark}{s}", np.int64)
                val = lists(table, f"val{mark}{s}")[1]
                row = np.repeat(np.arange(len(ids)), np.diff(offsets))
                order = np.lexsort((idx, row, idx // terms))
                idx, val, row = idx[order], val[order], row[order]
                ends = np.searchsorted(idx // terms, np.arange(blocks + 1))
                for b, (start, end) in enumerate(zip(ends[:-1], ends[1:])):
                    ptr = np.searchsorted(row[start:end], np.arange(len(ids) + 1)).astype(np.int32)
                    of_block[b] += [ptr, (idx[start:end] - b * terms).astype(np.int32), val[start:end]]
            out += [_row(b * parts + tile % parts, 1, tile, role, SLICE, *a) for b, a in enumerate(of_block)]
        return pa.Table.from_batches(out)

    return materialize(dealt.groupBy("tile").applyInArrow(cut, _STREAM), "slices")


def _packed_blocks(weights: DataFrame, slots: DataFrame | None, names: tuple[str, ...], layout: Layout) -> DataFrame:
    """Weights ``(term_id, w, bv)`` and the slots' as one row a block."""
    rows = weights.select(F.lit(-1).alias("slot"), "term_id", "w", "bv")
    for i, name in enumerate(names):
        if slots is not None:
            own = slots.where((F.col("slot") == name) & (F.col("term_id") >= 0))
            rows = rows.unionByName(own.select(F.lit(i).alias("slot"), "term_id", "w", "bv"))
    rows = rows.withColumn("block", F.floor(F.col("term_id") / layout.terms))

    def pack(table: pa.Table) -> pa.Table:
        slot, term = table.column("slot").to_numpy(), table.column("term_id").to_numpy()
        table = table.take(pa.array(np.lexsort((term, slot))))
        slot, bv = table.column("slot").to_numpy(), table.column("bv").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
        flat = lists(table, "w")[1].reshape(len(slot), -1)
        arrays = [a for s, e in zip(cuts[:-1], cuts[1:]) for a in (flat[s:e].ravel(), bv[s:e])]
        return pa.Table.from_batches([_row(table.column("block")[0].as_py(), 0, -1, -1, PARAMS, *arrays)])

    return materialize(rows.groupBy("block").applyInArrow(pack, _STREAM), "blocks")


def _term_table(blocks: DataFrame, names: tuple[str, ...], layout: Layout) -> DataFrame:
    """``(slot, term_id, w, bv)`` of all blocks; the weights themselves have an empty slot name."""
    terms, k = layout.terms, layout.k

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data")):
                arrays = _unpack(data.as_py())
                for name, w, bv in zip(("", *names), arrays[::2], arrays[1::2]):
                    ends = pa.array(np.arange(len(bv) + 1) * k, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(bv)),
                            pa.array(key * terms + np.arange(len(bv)), pa.int32()),
                            pa.ListArray.from_arrays(ends, pa.array(w)),
                            pa.array(bv),
                        ],
                        names=["slot", "term_id", "w", "bv"],
                    )

    return blocks.select("key", "data").mapInArrow(unpack, "slot string, term_id int, w array<double>, bv double")


class BlockedParameters:
    """Parameters in blocks, with the steps of a fit on them."""

    def __init__(
        self, spark: SparkSession, config: EncoderConfig, model: EncoderModel, explicit: bool = False,
        block_bytes: int = BLOCK_BYTES,
    ):
        ship(spark)
        self.spark, self.c, self.explicit = spark, config, explicit
        self.layout = Layout(spark, model.n_features, model.n_components, block_bytes)
        self.enc, self.dec = model.enc_act_func, model.dec_act_func
        self.updater = M.Updater(config.opt, config.learning_rate, config.momentum)
        self.updater.steps = model.steps
        names = self.updater.slot_names()
        bias = {} if model.slots is None else {
            r["slot"]: np.array(r["w"]) for r in model.slots.where("term_id = -1").collect()
        }
        # Slots of another rule are left behind, as a rule starts anew.
        known = model.slots if set(names) <= set(bias) else None
        self.blocks = _packed_blocks(model.weights, known, names, self.layout)
        self.bh = np.array(model.hidden_bias.first()["bh"], dtype=float)
        if known is not None:
            none = {"w": np.zeros((0, self.layout.k)), "bv": np.zeros(0)}  # the bias alone is updated here
            self.updater.slots = {s: {"bh": bias[s], **none} for s in names}

    # Copies of rows for the view by block.
    def _params(self) -> DataFrame:
        part = F.explode(F.sequence(F.lit(0), F.lit(self.layout.parts - 1)))
        copied = self.blocks.withColumn("part", part)
        return copied.withColumn("key", F.col("key") * self.layout.parts + F.col("part")).select(_NAMES)

    def _to_blocks(self, tiles: DataFrame) -> DataFrame:
        block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.layout.blocks - 1).cast("bigint")))
        parts = self.layout.parts
        copied = tiles.withColumn("block", block)
        return copied.withColumn("key", F.col("block") * parts + F.pmod("tile", F.lit(parts))).select(_NAMES)

    def _codes(self, slices: DataFrame) -> DataFrame:
        products = _stream(self._params().union(slices.where(F.col("kind") == SLICE)), functools.partial(_Products, parts=self.layout.parts))
        return materialize(_stream(products, functools.partial(_Codes, bh=self.bh, enc=self.enc)), "codes")

    def _reconstructed(self, slices: DataFrame, codes: DataFrame, weights: DataFrame | None, loss: str, grad: bool) -> DataFrame:
        rows = self._params().union(slices.where(F.col("kind") == SLICE)).union(self._to_blocks(codes))
        if loss not in ("cross_entropy", "mean_squared"):
            norms = _stream(rows, functools.partial(_Norms, dec=self.dec))
            norms = _stream(norms, functools.partial(_Summed, kind=NORMS))
            rows = rows.union(self._to_blocks(norms))
        if weights is not None:
            rows = rows.union(self._to_blocks(weights.where(F.col("kind") == WEIGHT)))
        make = functools.partial(_Backward, parts=self.layout.parts, dec=self.dec, loss=loss, with_grad=grad)
        return materialize(_stream(rows, make), "reconstructed")

    def row_codes(self, slices: DataFrame, codes: DataFrame) -> DataFrame:
        """``(batch_id, id, label, encode)``."""
        rows = codes.where("role = 0").union(slices.where(F.col("kind") == IDS))
        schema = "batch_id bigint, id bigint, label bigint, encode array<double>"
        return _stream(rows, functools.partial(_RowCodes, kind=CODE), schema)

    def _triplet_rows(self, found: DataFrame, slices: DataFrame, n_rows: int, slope: float) -> DataFrame:
        """Weights and slopes of the rows, tile by tile."""
        tiles = max(1, math.ceil(n_rows / self.layout.tile_rows))

        def pack(table: pa.Table) -> pa.Table:
            table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
            tile = table.column("tile")[0].as_py()
            grad = lists(table, "grad")[1] * slope
            weight = table.column("weight").to_numpy()
            return pa.Table.from_batches(
                [_row(tile, 1, tile, 0, WEIGHT, weight), _row(tile, 1, tile, 0, SLOPE, grad)]
            )

        dealt = found.select(F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile"), "id", "weight", "grad")
        return materialize(dealt.groupBy("tile").applyInArrow(pack, _STREAM), "weights")

    def step(self, batch: DataFrame, n_rows: int, suffixes: tuple[str, ...], triplets: Callable | None) -> np.ndarray:
        """One update; ``(weighted loss, weight, triplet loss, rows)``, and the online triplets' sums.

        ``triplets(codes)`` gives ``(id, weight, loss, active, valid, grad)`` and
        the factor of ``grad``.
        """
        c, layout = self.c, self.layout
        slices = _slices(batch, layout, n_rows, suffixes)
        codes = self._codes(slices)
        weights, sums, used = None, np.zeros(3), []
        if triplets is not None:
            found, slope = triplets(self.row_codes(slices, codes))
            weights = self._triplet_rows(found, slices, n_rows, slope)
            totals = found.agg(*[F.sum(n).alias(n) for n in ("loss", "active", "valid")]).first()
            sums, used = np.array([totals[n] for n in ("loss", "active", "valid")], dtype=float), [found, weights]
        back = self._reconstructed(slices, codes, weights, c.loss_func, True)
        through = back.where(F.col("kind") == PART).union(codes)
        if weights is not None:
            through = through.union(weights)
        make = functools.partial(_ThroughCodes, bh=self.bh, enc=self.enc, explicit=self.explicit, alpha=c.alpha)
        deltas = materialize(_stream(through, make), "deltas")
        # At most _SUMS rows of the hidden bias's size.
        totals = [_unpack(r["data"]) for r in _stream(deltas.where(F.col("kind") == TOTAL), _Totals).collect()]
        gh, stats = (np.sum([t[i] for t in totals], axis=0) for i in (0, 1))
        scale = 1.0 / stats[3] if self.explicit else 1.0 / (stats[1] + EPS)

        moved = self._to_blocks(deltas.where(F.col("kind") == DELTA)).union(slices.where(F.col("kind") == SLICE))
        make = functools.partial(_FromInput, parts=layout.parts, terms=layout.terms, n_features=layout.n_features)
        gradients = _stream(moved, make).union(back.where(F.col("kind") == GRADIENT))
        make = functools.partial(_Update, c=c, steps=self.updater.steps, scale=scale)
        blocks = materialize(_stream(self.blocks.union(gradients), make), "blocks")
        discard(self.blocks, slices, codes, back, deltas, *used)
        self.blocks = blocks
        old = M.Params(np.zeros((0, layout.k)), self.bh, np.zeros(0))
        grad = M.Gradient(old)
        grad.bh = gh * scale
        self.bh = self.updater.apply(old, grad).bh
        return np.concatenate([stats, sums])

    def losses(self, rows: DataFrame, n_rows: int, loss: str) -> tuple[DataFrame, DataFrame]:
        """``(id, loss)`` and ``(batch_id, id, label, encode)`` of rows without corruption of their own."""
        slices = _slices(rows, self.layout, n_rows, ("",))
        codes = self._codes(slices)
        back = self._reconstructed(slices, codes, None, loss, False)
        summed = _stream(back, functools.partial(_Summed, kind=WEIGHT)).union(slices.where(F.col("kind") == IDS))
        found = _stream(summed, functools.partial(_RowCodes, kind=WEIGHT), "id bigint, loss double")
        return found, self.row_codes(slices, codes)

    def explicit_cost(self, rows: DataFrame, n_rows: int, suffixes: tuple[str, ...]) -> np.ndarray:
        """``(loss, weight, triplet loss, rows)`` of given triplets."""
        slices = _slices(rows, self.layout, n_rows, suffixes)
        codes = self._codes(slices)
        back = self._reconstructed(slices, codes, None, self.c.loss_func, False)
        # Slopes are not wanted: codes stand in for them.
        zero = functools.partial(_Costs, k=self.layout.k)
        totals = _stream(back.where(F.col("kind") == PART).union(codes), zero)
        found = [_unpack(r["data"])[0] for r in _stream(totals, _Totals).collect()]
        discard(slices, codes, back)
        return np.sum(found, axis=0)

    def tables(self) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """Weights, slots and hidden bias as tables of a model."""
        names = self.updater.slot_names()
        every = materialize(_term_table(self.blocks, names, self.layout), "terms")
        weights = every.where("slot = ''").select("term_id", "w", "bv")
        bias = self.spark.createDataFrame([(self.bh.tolist(),)], "bh array<double>")
        if not names or not self.updater.slots:
            return weights, None, bias
        rows = [(s, -1, self.updater.slots[s]["bh"].tolist(), 0.0) for s in names]
        hidden = self.spark.createDataFrame(rows, "slot string, term_id int, w array<double>, bv double")
        return weights, every.where("slot <> ''").unionByName(hidden), bias


class _Costs(_ByTile):
    """Losses of given triplets, a row of totals per tile."""

    def __init__(self, key: int, k: int):
        super().__init__(key)
        self.k = k

    def end(self) -> Iterable[pa.RecordBatch]:
        h = {role: data[0].reshape(-1, self.k) for (kind, role), data in self.held.items() if kind == CODE}
        gap = (h[0] * (h[2] - h[1])).sum(1)
        loss = sum(s[1].sum() for s in self.sums.values())
        totals = np.array([loss, len(gap), M.softplus(gap).sum(), len(gap)])
        yield _row(self.tile % _SUMS, 1, self.tile, -1, TOTAL, totals)


def row_losses(model: EncoderModel, rows: DataFrame, id_col: str, loss_func: str, clean: str | None) -> DataFrame:
    """``(id, loss)`` of packed rows under parameters that stay a table."""
    named = rows.select(
        F.col(id_col).cast("bigint").alias("id"), "idx", F.col(clean or "val").alias("val"),
        F.col("idx").alias("idx_c"), F.col("val").alias("val_c"),
    )
    held = BlockedParameters(rows.sparkSession, EncoderConfig(triplet_strategy="none"), model)
    losses, _ = held.losses(named, rows.count(), loss_func)
    return losses.withColumnRenamed("id", id_col)


__all__ = ["BLOCK_BYTES", "BlockedParameters", "row_losses"]
