"""Online triplets inside batches: masks, batch-all and batch-hard statistics.

Rows are ``(batch_id, id, label, encode)``. No pair or triplet ever becomes a
row: masks are stated through class counts, and losses are summed inside tiles
of anchors.

Batch-all tiles hold anchors of one class. A tile reads its anchors, then the
other rows of the class, which are the positives, then all other rows of the
batch, a few at a time: the negatives. So a row is copied once per tile of its
batch, and a task holds one class and a strip of products.

The triplets of an anchor are the pairs of its products with positives and with
negatives, and their losses and slopes are smooth functions of the difference.
As a function of the positive's product such a sum is a polynomial to the last
digits of a double, so it is taken at a few Chebyshev nodes, with the weights
that the positives have there, instead of at every positive: the work is squared
in the batch, not cubic. Counts of active triplets come from sorted products and
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import EPS, softplus
from kinfold.operators.blocks import column, crossed, lists, opened, packed, rows_per_block, tasks_of
from kinfold.operators.ordering import lookup_join, running_totals
from kinfold.session import materialize, ship

TILE_ROWS = 256  # anchors that a task takes at once, at most
_PRODUCTS = 1 << 24  # products of a tile's anchors with a class that a task holds, at most
_NEGATIVES = 4096  # negatives taken at once
_TERMS = 1 << 18  # products of an anchor with nodes that are held at once
_HOT = 1e-16  # a triplet is active if its difference is above
_BLOCK_ROWS = 8192  # rows of a batch-hard block, at most
_STRIP = 1 << 18  # products of batch-hard that a task holds at once
_FEW = 4096  # slopes that are added one by one
DOT_DIGITS = 9  # dot products equal to this many digits count as equal


def batch_classes(df: DataFrame) -> DataFrame:
    """``(batch_id, label, c, n)``: class size and batch size."""
    classes = df.groupBy("batch_id", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = classes.groupBy("batch_id").agg(F.sum("c").alias("n"))
    return classes.join(sizes, "batch_id")


def triplet_masks(df: DataFrame) -> DataFrame:
    """Per row, how many partners each mask allows.

    ``positives``: distinct rows of the same label; ``negatives``: rows of
    another label; ``triplets``: pairs of one of each.
    """
    joined = lookup_join(
        df.select("batch_id", "id", "label", F.struct("batch_id", "label").alias("_class")),
        batch_classes(df).select(F.struct("batch_id", "label").alias("_class"), "c", "n"),
        "_class",
        salt_on="id",
    )
    pos, neg = F.col("c") - 1, F.col("n") - F.col("c")
    return joined.select(
        "batch_id", "id", "label", pos.alias("positives"), neg.alias("negatives"), (pos * neg).alias("triplets")
    )


def batch_all_weights(df: DataFrame, active_only: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(batch_id, id, weight)``: uses of each row as anchor, positive or negative.

    Over all valid triplets the count follows from class sizes: a row of a
    class of c in a batch of n is used 2(c-1)(n-c) times by its own class and
    c'(c'-1) times by every other class of size c'.
    """
    if active_only:
        rows = _tile_sums(df, tile_rows, True)
        return rows.groupBy("batch_id", "id").agg(F.sum("w_active").alias("weight"))
    classes = batch_classes(df)
    squares = classes.groupBy("batch_id").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("sq"))
    own = F.col("c") * (F.col("c") - 1)
    weight = 2 * (F.col("c") - 1) * (F.col("n") - F.col("c")) + F.col("sq") - own
    table = classes.join(squares, "batch_id").select(
        F.struct("batch_id", "label").alias("_class"), weight.cast("double").alias("weight")
    )
    rows = df.select("batch_id", "id", F.struct("batch_id", "label").alias("_class"))
    return lookup_join(rows, table, "_class", "inner", salt_on="id").select("batch_id", "id", "weight")


def batch_all(df: DataFrame, active_only: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(batch_id, loss, fraction, number)`` over all valid (or active) triplets."""
    sums = _tile_sums(df, tile_rows, active_only).groupBy("batch_id").agg(
        *[F.sum(c).alias(c) for c in ("valid", "active", "loss_valid", "loss_active")]
    )
    kind = "active" if active_only else "valid"
    return sums.select(
        "batch_id",
        (F.col(f"loss_{kind}") / (F.col(kind) + F.lit(EPS))).alias("loss"),
        (F.col("active") / (F.col("valid") + F.lit(EPS))).alias("fraction"),
        F.col("active").alias("number"),
    )


def _anchor_tiles(df: DataFrame, tile_rows: int) -> DataFrame:
    """Rows copied to each tile of anchors of their batch: ``_class``, ``_part`` and the row's ``_role`` there.

    Roles: 0 anchor, 1 other row of the class, 2 row of another class. Classes
    of one row, and batches of one class, have no triplets and no tiles.
    """
    classes = batch_classes(df).where("c > 1 AND c < n")
    # Anchors are few enough for their products with the class to be held.
    size = F.least(F.lit(tile_rows).cast("bigint"), F.greatest(F.floor(F.lit(_PRODUCTS) / F.col("c")), F.lit(1)))
    parts = F.ceil(F.col("c") / size).cast("bigint")
    listed = classes.groupBy("batch_id").agg(F.collect_list(F.struct("label", parts.alias("parts"))).alias("_classes"))
    each = F.flatten(
        F.transform(
            "_classes",
            lambda c: F.transform(
                F.sequence(F.lit(0).cast("bigint"), c["parts"] - 1),
                lambda p: F.struct(c["label"].alias("label"), p.alias("part"), c["parts"].alias("parts")),
            ),
        )
    )
    rows = lookup_join(df, listed, "batch_id", "inner", salt_on="id")
    tiles = rows.withColumn("_t", F.explode(each)).drop("_classes")
    own = F.pmod(F.xxhash64("id"), F.col("_t.parts")) == F.col("_t.part")
    role = F.when(F.col("label") != F.col("_t.label"), 2).when(own, 0).otherwise(1)
    return tiles.select(
        "batch_id", F.col("_t.label").alias("_class"), F.col("_t.part").alias("_part"), role.alias("_role"), "id", "encode"
    )


_SUMS_SCHEMA = (
    "batch_id bigint, id bigint, w_valid double, w_active double, "
    "valid double, active double, loss_valid double, loss_active double"
)
_GRAD_SCHEMA = _SUMS_SCHEMA + ", grad array<double>"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def _nodes_needed(width: float) -> int:
    """Chebyshev nodes on a range of this width that give softplus and its slope to 2e-16.

    Both are analytic up to pi beside the real axis, so the error falls by the
    sum of the half axes of the ellipse through there with every node.
    """
    if width <= 0:
        return 1
    half = 2 * np.pi / width
    return int(np.ceil(36 / np.log(half + np.sqrt(half * half + 1)))) + 4


def _polynomials(u: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """Chebyshev polynomials of degree 0 to ``count - 1``."""
    before, now = u, np.ones_like(u)  # T(-1) = T(1)
    for _ in range(count):
        yield now
        before, now = now, 2 * u * now - before


class _AnchorTile:
    """Sums over the triplets of some anchors of a class, as the rows of the batch come in."""

    def __init__(self, batch: int, active_only: bool, with_grad: bool, at_once: int = TILE_ROWS):
        self.batch, self.active_only, self.with_grad, self.at_once = batch, active_only, with_grad, at_once
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.ready = False

    def hold(self, role: int, ids: np.ndarray, h: np.ndarray) -> None:
        self.parts[role].append((ids, h))

    def _begin(self) -> bool:
        """All rows of the class are there: the anchors first."""
        if not self.parts[0]:
            return False
        parts = self.parts[0] + self.parts[1]
        self.anchors = sum(len(ids) for ids, _ in self.parts[0])
        self.ids, self.h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.dots = self.h[: self.anchors] @ self.h.T
        n, m = self.anchors, len(self.ids)
        self.negatives = 0
        self.active, self.loss = np.zeros(n), np.zeros((2, n))
        self.uses = np.zeros(m)  # of the class in active triplets, as positives
        low, high = self.dots.min(1, keepdims=True), self.dots.max(1, keepdims=True)
        count = _nodes_needed(float((high - low).max()))
        # The anchor itself is no positive.
        own = np.arange(n)
        self.smooth = 2 * count < m and not (self.active_only and self.with_grad)
        if self.smooth:
            half = np.maximum((high - low) / 2, np.finfo(float).tiny)
            place = np.cos(np.pi * (np.arange(count) + 0.5) / count)
            self.nodes = (low + high) / 2 + half * place
            self.at = (self.dots - (low + high) / 2) / half
            # Row j of the table: the part of polynomial j in the function that is 1 at a node and 0 at the others.
            self.table = np.stack(list(_polynomials(place, count))) * 2 / count
            self.table[0] /= 2
            self.weights = np.stack([t.sum(1) - t[own, own] for t in _polynomials(self.at, count)], 1) @ self.table
        else:
            self.nodes, self.weights = self.dots, np.ones((n, m))
            self.weights[own, own] = 0.0
        others = self.dots.copy()
        others[own, own] = np.inf
        self.order = others.argsort(1)
        self.sorted = np.take_along_axis(others, self.order, 1)
        self.slope, self.grad = np.zeros(self.nodes.shape), np.zeros((n, self.h.shape[1]))
        self.ready = True
        return True

    def _below(self, i: int, x: np.ndarray) -> np.ndarray:
        """How many positives of an anchor make active triplets with each product."""
        edge = x - _HOT
        edge = np.where(x - edge > _HOT, np.nextafter(edge, np.inf), edge)
        return self.sorted[i].searchsorted(edge)

    def _active_weights(self, i: int) -> np.ndarray:
        """Weights at the nodes of the first 0, 1, ... positives of an anchor in rising order."""
        rising = self.at[i][self.order[i]]
        sums = np.zeros((len(rising) + 1, len(self.table)))
        for j, t in enumerate(_polynomials(rising, len(self.table))):
            np.cumsum(t, out=sums[1:, j])
        return sums @ self.table

    def _meet(self, i: int, x: np.ndarray, below: np.ndarray, first: np.ndarray | None) -> np.ndarray | None:
        """Add the triplets of an anchor with some negatives; their slopes by the negatives' products."""
        d = x[:, None] - self.nodes[i]
        e = np.exp(-np.abs(d))
        cost = np.maximum(d, 0.0) + np.log1p(e)
        self.loss[0, i] += (cost @ self.weights[i]).sum()
        if self.active_only:
            used = first[below] if first is not None else (d > _HOT) * self.weights[i]
            self.loss[1, i] += (cost * used).sum()
        if not self.with_grad:
            return None
        slope = np.where(d >= 0, 1.0, e) / (1.0 + e)
        if self.active_only:
            slope *= d > _HOT
        self.slope[i] -= slope.sum(0)
        return slope @ self.weights[i]

    def negative(self, ids: np.ndarray, h: np.ndarray) -> pa.RecordBatch | None:
        if not self.ready and not self._begin():
            return None
        n, m = self.anchors, len(self.ids)
        hot_sum, back = np.zeros(len(ids)), np.zeros((n if self.with_grad else 0, len(ids)))
        step = max(1, _TERMS // self.nodes.shape[1])
        for i in range(n):
            at = i % self.at_once
            if at == 0:
                products = self.h[i : min(i + self.at_once, n)] @ h.T
            below = self._below(i, products[at])
            self.active[i] += below.sum()
            first = None
            if self.active_only:
                hot_sum += below
                above = len(ids) - np.cumsum(np.bincount(below, minlength=m + 1))[:m]
                self.uses[self.order[i]] += above
                first = self._active_weights(i) if self.smooth else None
            for s in range(0, len(ids), step):
                part = slice(s, s + step)
                slope = self._meet(i, products[at, part], below[part], first)
                if slope is not None:
                    back[i, part] = slope
        self.negatives += len(ids)
        grad = None
        if self.with_grad:
            self.grad += back @ h
            grad = back.T @ self.h[:n]
        zero = np.zeros(len(ids))
        return _sums(self.batch, ids, zero + n * (m - 1), hot_sum, zero, zero, zero, zero, grad)

    def _class_slopes(self) -> np.ndarray:
        """Slopes by the products of the anchors with the class."""
        n, m = self.dots.shape
        if self.smooth:
            parts, slope = self.slope @ self.table.T, np.zeros((n, m))
            for j, t in enumerate(_polynomials(self.at, parts.shape[1])):
                slope += parts[:, j : j + 1] * t
        else:
            slope = self.slope
        slope[np.arange(n), np.arange(n)] = 0.0
        return slope

    def done(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            return
        n, m, zero = self.anchors, len(self.ids), np.zeros(len(self.ids))
        # Valid triplets follow from the sizes: every (a, p) with a <> p meets every negative.
        valid, active = zero.copy(), zero.copy()
        valid[:n] = (m - 1) * self.negatives
        active[:n] = self.active
        losses = np.zeros((2, m))
        losses[:, :n] = self.loss
        weight = valid + self.negatives * (n - (np.arange(m) < n))
        grad = None
        if self.with_grad:
            slope = self._class_slopes()
            grad = slope.T @ self.h[:n]
            grad[:n] += self.grad + slope @ self.h
        yield _sums(self.batch, self.ids, weight, active + self.uses, valid, active, *losses, grad)


def _sums(batch: int, ids, w_valid, w_active, valid, active, loss_valid, loss_active, grad) -> pa.RecordBatch:
    numbers = (w_valid, w_active, valid, active, loss_valid, loss_active)
    columns = [pa.array(np.full(len(ids), batch), pa.int64()), pa.array(ids, pa.int64())]
    columns += [pa.array(np.asarray(x, float)) for x in numbers]
    names = ["batch_id", "id", "w_valid", "w_active", "valid", "active", "loss_valid", "loss_active"]
    if grad is not None:
        ends = pa.array(np.arange(len(ids) + 1) * grad.shape[1], pa.int32())
        columns.append(pa.ListArray.from_arrays(ends, pa.array(grad.ravel())))
        names.append("grad")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _anchor_sums(active_only: bool, with_grad: bool, at_once: int):
    """Rows come sorted by (batch, class, part, role)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tile = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("batch_id", "_class", "_part", "_role")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=0) != 0).any(1)) + 1).tolist(), len(marks)]
            table = pa.Table.from_batches([batch])
            for start, end in zip(cuts[:-1], cuts[1:]):
                mark, role = tuple(marks[start, :3]), int(marks[start, 3])
                if mark != current:
                    if tile is not None:
                        yield from tile.done()
                    current, tile = mark, _AnchorTile(mark[0], active_only, with_grad, at_once)
                part = table.slice(start, end - start)
                ids, h = column(part, "id"), lists(part, "encode")[1].reshape(end - start, -1)
                if role < 2:
                    tile.hold(role, ids, h)
                    continue
                for s in range(0, len(ids), _NEGATIVES):
                    found = tile.negative(ids[s : s + _NEGATIVES], h[s : s + _NEGATIVES])
                    if found is not None:
                        yield found
        if tile is not None:
            yield from tile.done()

    return run


def _prepared(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df.select(
        F.col("batch_id").cast("bigint"),
        F.col("id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.col("encode").cast("array<double>"),
    )


def _tile_sums(df: DataFrame, tile_rows: int, active_only: bool, with_grad: bool = False) -> DataFrame:
    """Sums in parts, to be added up per row; every row is there once with zeros.

    ``tile_rows`` anchors meet the negatives at once. A row is copied once per
    tile of its batch, so tiles are dealt no smaller than ``TILE_ROWS``, but for
    gradients, where a fit chooses tiles that occupy the cores.
    """
    dealt_rows = tile_rows if with_grad else max(tile_rows, TILE_ROWS)
    rows = _prepared(df)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["batch_id", "_class", "_part"]
    dealt = _anchor_tiles(rows, dealt_rows).repartition(parts, *order).sortWithinPartitions(*order, "_role")
    found = dealt.mapInArrow(_anchor_sums(active_only, with_grad, tile_rows), _GRAD_SCHEMA if with_grad else _SUMS_SCHEMA)
    names = ("w_valid", "w_active", "valid", "active", "loss_valid", "loss_active")
    none = [F.lit(0.0).alias(n) for n in names]
    if with_grad:
        none.append(F.transform("encode", lambda x: F.lit(0.0)).alias("grad"))
    return found.unionByName(rows.select("batch_id", "id", *none))


def batch_all_rows(df: DataFrame, active_only: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Tile sums with the loss gradient by ``encode`` (before division by the
    number of triplets), several rows per id to be added up by the caller."""
    return _tile_sums(df, tile_rows, active_only, True)


def _hard_sizes(df: DataFrame) -> tuple[DataFrame | None, int, int]:
    """``(batch_id, _k, _first)`` by batch: how many blocks, and the number of the first where there are
    several, or nothing if no batch has more than one; then how many blocks these batches have, and their bytes."""
    held = F.coalesce(F.sum(F.greatest(F.size("encode"), F.lit(0))), F.lit(0)) * 8
    sizes = materialize(df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"), held.alias("_bytes")), "sizes")
    n, n_bytes, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0)), F.max("_n")).first()
    block_rows = min(_BLOCK_ROWS, rows_per_block(n, n_bytes))
    if (most or 0) <= block_rows:
        return None, 0, 0
    sizes = sizes.withColumn("_k", F.ceil(F.col("_n") / F.lit(block_rows)).cast("bigint"))
    large = sizes.where("_k > 1")
    blocks, n_bytes = large.agg(F.sum("_k"), F.sum("_bytes")).first()
    upto = running_totals(large.select("batch_id", "_k"), ["batch_id"], {"_k": "_upto"}, "blocks")
    first = upto.select("batch_id", (F.col("_upto") - F.col("_k")).cast("bigint").alias("_first"))
    table = materialize(sizes.select("batch_id", "_k").join(first, "batch_id", "left"), "sizes")
    return table, blocks, n_bytes


def _hard_tiles(df: DataFrame, sizes: tuple[DataFrame | None, int, int]) -> DataFrame:
    """``(_l, _r, _left, _right)``: packed blocks of a batch that meet, in both orders.

    Batches of one block have no right side: their rows are shuffled once and
    meet in the task that packs them. The blocks of larger ones are crossed.
    """
    table, blocks, n_bytes = sizes
    parts = tasks_of(df.sparkSession)
    if table is None:
        return _whole_batches(df, parts)
    rows = lookup_join(df, table, "batch_id", "inner", salt_on="id", stored=True)
    number = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_k"))
    numbered = rows.where("_k > 1").withColumn("_block", number).withColumnRenamed("_first", "_group").drop("_k")
    cut = packed(numbered, ["_block", "_group"], "id", parts)
    tiles = crossed(cut, "_block", blocks, n_bytes, group="_group")
    return _whole_batches(rows.where("_k = 1").drop("_k", "_first"), parts).unionByName(tiles)


def _whole_batches(df: DataFrame, parts: int) -> DataFrame:
    small = packed(df.withColumn("_batch", F.col("batch_id")), ["_batch"], "id", parts)
    key, none = F.col("_batch"), F.lit(None).cast("binary")
    return small.select(key.alias("_l"), key.alias("_r"), F.col("_rows").alias("_left"), none.alias("_right"))


class _Block:
    """Rows of a batch, by label, those without one at the end."""

    def __init__(self, table: pa.Table):
        label = table.column("label").combine_chunks()
        known = label.is_valid().to_numpy(zero_copy_only=False)
        label = label.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((label, ~known))
        self.table, self.label, self.known = table.take(pa.array(order)), label[order], known[order]
        self.h = lists(self.table, "encode")[1].reshape(len(order), -1)
        # Runs of a label; the rows without one are the last run.
        edges = np.flatnonzero((np.diff(self.label) != 0) | (np.diff(self.known) != 0)) + 1
        self.starts = np.concatenate([[0], edges]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.label)

    def field(self, name: str) -> np.ndarray:
        return column(self.table, name).astype(float)

    def run_of(self, other: _Block, rows: slice) -> np.ndarray:
        """The run in this block with the label of the other's rows, or -1."""
        runs = self.starts[self.known[self.starts]]
        if not len(runs):
            return np.full(len(other.label[rows]), -1)
        at = np.minimum(self.label[runs].searchsorted(other.label[rows]), len(runs) - 1)
        return np.where(other.known[rows] & (self.label[runs][at] == other.label[rows]), at, -1)

    def emitted(self, **columns) -> pa.RecordBatch:
        keys = [self.table.column(c).combine_chunks().cast(pa.int64()) for c in ("batch_id", "id")]
        return pa.RecordBatch.from_arrays([*keys, *columns.values()], names=["batch_id", "id", *columns])


def _dots(anchors: _Block, others: _Block, tile_rows: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Dot products of some anchors at a time with all others; every pass makes the same strips."""
    step = max(1, min(tile_rows, _STRIP // len(others)))
    for s in range(0, len(anchors), step):
        rows = slice(s, min(s + step, len(anchors)))
        yield rows, anchors.h[rows] @ others.h.T


def _hard_pass(meeting, *args):
    """Let a left block meet the right ones that follow each other, and emit its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, sums = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                alone = not batch.column("_right")[i].is_valid
                l, r = batch.column("_l")[i].as_py(), batch.column("_r")[i].as_py()
                if (alone, l) != key:
                    if sums is not None:
                        yield sums.done()
                    key, left = (alone, l), _Block(opened(batch, "_left", i))
                    sums = meeting(left, *args)
                sums.meet(left if alone or l == r else _Block(opened(batch, "_right", i)))
        if sums is not None:
            yield sums.done()

    return run


_EXTREMES_SCHEMA = (
    "batch_id bigint, id bigint, row_max double, min_pos double, min_other double, max_neg double"
)


class _Extremes:
    """Per anchor, which is a left row: extremes of its dot products by mask."""

    def __init__(self, left: _Block, tile_rows: int):
        self.left, self.tile_rows = left, tile_rows
        self.low, self.high = np.full((2, len(left)), np.inf), np.full((2, len(left)), -np.inf)

    def meet(self, right: _Block) -> None:
        left, low, high = self.left, self.low, self.high
        for rows, dots in _dots(left, right, self.tile_rows):
            at, own = np.arange(len(dots)), right.run_of(left, rows)
            has = np.flatnonzero(own >= 0)
            if right is left:  # an anchor is no partner of itself
                itself = dots[at, at + rows.start].copy()
                dots[at, at + rows.start] = -np.inf
            top = np.maximum.reduceat(dots, right.starts, axis=1)
            if right is left:
                dots[at, at + rows.start] = np.inf
            least = np.minimum.reduceat(dots, right.starts, axis=1)
            row_max = top.max(1)
            min_pos = np.full(len(dots), np.inf)
            min_pos[has] = least[has, own[has]]
            least[has, own[has]], top[has, own[has]] = np.inf, -np.inf
            min_other, max_neg = least.min(1), top.max(1)
            if right is left:
                row_max, min_other = np.maximum(row_max, itself), np.minimum(min_other, itself)
                max_neg = np.where(left.known[rows], max_neg, np.maximum(max_neg, itself))
            high[0, rows], high[1, rows] = np.maximum(high[0, rows], row_max), np.maximum(high[1, rows], max_neg)
            low[0, rows], low[1, rows] = np.minimum(low[0, rows], min_pos), np.minimum(low[1, rows], min_other)

    def done(self) -> pa.RecordBatch:
        def kept(values: np.ndarray) -> pa.Array:  # rounding keeps the order
            values = np.round(values, DOT_DIGITS)
            return pa.array(values, pa.float64(), mask=~np.isfinite(values))

        found = {"row_max": self.high[0], "min_pos": self.low[0], "min_other": self.low[1], "max_neg": self.high[1]}
        return self.left.emitted(**{name: kept(values) for name, values in found.items()})


def hardest(df: DataFrame, mode: str = "reference", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(batch_id, id, hardest_pos, hardest_neg, dist, active)`` per anchor.

    ``reference`` keeps the usual masked formulas: entries that are no positive
    are raised by the row maximum before the minimum, entries that are no
    negative count as 0 in the maximum. ``strict`` looks at true positives and
    negatives only; an anchor that lacks either is inactive.
    """
    rows = _prepared(df).where("batch_id IS NOT NULL")
    return _hardest(rows, _hard_sizes(rows), mode, tile_rows)


def _hardest(prepared: DataFrame, sizes, mode: str, tile_rows: int) -> DataFrame:
    if mode not in ("reference", "strict"):
        raise ValueError("mode must be reference or strict")
    partial = _hard_tiles(prepared, sizes).mapInArrow(_hard_pass(_Extremes, tile_rows), _EXTREMES_SCHEMA)
    rows = partial.groupBy("batch_id", "id").agg(
        F.max("row_max").alias("row_max"),
        F.min("min_pos").alias("min_pos"),
        F.min("min_other").alias("min_other"),
        F.max("max_neg").alias("max_neg"),
    )
    if mode == "reference":
        pos = F.least(F.col("min_pos"), F.col("min_other") + F.col("row_max"))
        neg = F.greatest(F.col("max_neg"), F.lit(0.0))
    else:
        pos, neg = F.col("min_pos"), F.col("max_neg")
    dist = F.coalesce(F.greatest(F.col("hardest_neg") - F.col("hardest_pos"), F.lit(0.0)), F.lit(0.0))
    known = F.col("hardest_neg").isNotNull() & F.col("hardest_pos").isNotNull()
    return (
        rows.select("batch_id", "id", "row_max", pos.alias("hardest_pos"), neg.alias("hardest_neg"))
        .withColumn("dist", F.when(known, dist).otherwise(0.0))
        .withColumn("active", F.when(F.col("dist") > 0, 1.0).otherwise(0.0))
    )


def batch_hard(df: DataFrame, mode: str = "reference", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(batch_id, loss, fraction, number, mean_hardest_pos, mean_hardest_neg)``."""
    rows = hardest(df, mode, tile_rows)
    number = F.sum("active")
    return rows.groupBy("batch_id").agg(
        (F.sum(softplus(F.col("dist")) * F.col("active")) / (number + F.lit(EPS))).alias("loss"),
        (number / F.count(F.lit(1))).alias("fraction"),
        number.alias("number"),
        F.avg("hardest_pos").alias("mean_hardest_pos"),
        F.avg("hardest_neg").alias("mean_hardest_neg"),
    )


_USES_SCHEMA = "batch_id bigint, id bigint, uses double"
_HARD_GRAD_SCHEMA = _USES_SCHEMA + ", grad array<double>"


def _hits(anchors: _Block, rows: slice, dots: np.ndarray) -> np.ndarray:
    """How often the other rows' products are a hardest one of an active anchor."""
    active, uses = anchors.field("active")[rows] > 0, np.zeros(dots.shape[1])
    for name in ("hardest_pos", "hardest_neg"):
        value = np.where(active, anchors.field(name)[rows], np.nan)
        uses += np.bincount(np.nonzero(dots == value[:, None])[1], minlength=len(uses))
    return uses


class _Uses:
    """Per left row, its uses by the anchors, which are the right rows."""

    def __init__(self, left: _Block, tile_rows: int):
        self.left, self.tile_rows, self.uses = left, tile_rows, np.zeros(len(left))

    def meet(self, right: _Block) -> None:
        for rows, dots in _dots(right, self.left, self.tile_rows):
            self.uses += _hits(right, rows, np.round(dots, DOT_DIGITS))

    def done(self) -> pa.RecordBatch:
        return self.left.emitted(uses=pa.array(self.uses))


def batch_hard_weights(df: DataFrame, mode: str = "reference", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(batch_id, id, weight)``: active as anchor, plus every time a dot product
    with the row equals the hardest positive or negative of an active anchor."""
    prepared = _prepared(df).where("batch_id IS NOT NULL")
    sizes = _hard_sizes(prepared)
    found = materialize(_hardest(prepared, sizes, mode, tile_rows), "hardest")
    tiles = _hard_tiles(prepared.join(found.drop("row_max", "dist"), ["batch_id", "id"]), sizes)
    uses = tiles.mapInArrow(_hard_pass(_Uses, tile_rows), _USES_SCHEMA)
    own = found.select("batch_id", "id", F.col("active").alias("uses"))
    return uses.unionByName(own).groupBy("batch_id", "id").agg(F.sum("uses").alias("weight"))


_TIES_SCHEMA = "batch_id bigint, id bigint, n_pos double, n_masked double, n_neg double, n_max double"


def _entries(anchors: _Block, rows: slice, others: _Block, dots: np.ndarray, strict: bool):
    """Which products attain the anchors' extremes, with their masks."""
    field = lambda name: anchors.field(name)[rows][:, None]
    same = (anchors.label[rows][:, None] == others.label) & anchors.known[rows][:, None] & others.known
    positive = same
    if others is anchors:
        positive = same.copy()
        positive[np.arange(len(dots)), np.arange(rows.start, rows.stop)] = False
    if strict:
        at_pos = positive & (dots == field("hardest_pos"))
        at_neg = ~same & (dots == field("hardest_neg"))
    else:
        at_pos = np.where(positive, dots, dots + field("row_max")) == field("hardest_pos")
        at_neg = np.where(~same, dots, 0.0) == field("hardest_neg")
    return same, positive, at_pos, at_neg, dots == field("row_max")


class _Ties:
    """Per anchor, which is a left row: how many products attain its extremes."""

    def __init__(self, left: _Block, tile_rows: int, strict: bool):
        self.left, self.tile_rows, self.strict = left, tile_rows, strict
        self.counts = np.zeros((4, len(left)))

    def meet(self, right: _Block) -> None:
        for rows, dots in _dots(self.left, right, self.tile_rows):
            dots = np.round(dots, DOT_DIGITS)
            _, positive, at_pos, at_neg, at_max = _entries(self.left, rows, right, dots, self.strict)
            for count, mask in zip(self.counts, (at_pos, at_pos & ~positive, at_neg, at_max)):
                count[rows] += mask.sum(1)

    def done(self) -> pa.RecordBatch:
        names = ("n_pos", "n_masked", "n_neg", "n_max")
        return self.left.emitted(**{name: pa.array(count) for name, count in zip(names, self.counts)})


class _HardSlopes:
    """Per left row, its uses and code gradient, as an anchor and as a partner; equal extremes share the slope."""

    def __init__(self, left: _Block, tile_rows: int, strict: bool):
        self.left, self.tile_rows, self.strict = left, tile_rows, strict
        self.uses, self.grad = np.zeros(len(left)), np.zeros(left.h.shape)

    def _slopes(self, anchors: _Block, rows: slice, others: _Block, dots: np.ndarray) -> np.ndarray:
        field = lambda name: anchors.field(name)[rows][:, None]
        share = lambda name: np.maximum(field(name), 1.0)
        same, _, at_pos, at_neg, at_max = _entries(anchors, rows, others, dots, self.strict)
        slope = field("active") * _sigmoid(field("dist"))
        g = slope * at_neg * ~same / share("n_neg") - slope * at_pos / share("n_pos")
        if not self.strict:
            # A masked entry holding the minimum moves the row maximum too.
            g -= slope * field("n_masked") / share("n_pos") * at_max / share("n_max")
        return np.nan_to_num(g)

    def meet(self, right: _Block) -> None:
        left = self.left
        for rows, dots in _dots(right, left, self.tile_rows):
            dots = np.round(dots, DOT_DIGITS)
            self.uses += _hits(right, rows, dots)
            g = self._slopes(right, rows, left, dots)
            self._add(slice(None), g.T, right.h[rows])
            if right is left:
                self._add(rows, g, right.h)
        if right is not left:
            for rows, dots in _dots(left, right, self.tile_rows):
                self._add(rows, self._slopes(left, rows, right, np.round(dots, DOT_DIGITS)), right.h)

    def _add(self, rows: slice, g: np.ndarray, h: np.ndarray) -> None:
        i, j = np.nonzero(g)
        if len(i) > _FEW:
            self.grad[rows] += g @ h
        else:  # few products are extremes
            np.add.at(self.grad[rows], i, g[i, j][:, None] * h[j])

    def done(self) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(self.left) + 1) * self.grad.shape[1], pa.int32())
        grad = pa.ListArray.from_arrays(ends, pa.array(self.grad.ravel()))
        return self.left.emitted(uses=pa.array(self.uses), grad=grad)


def batch_hard_rows(df: DataFrame, mode: str = "reference", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(id, weight, loss, active, valid, grad)`` in parts to be added up per id:
    weights, losses and the code gradient before division by the active count."""
    strict = mode == "strict"
    prepared = _prepared(df).where("batch_id IS NOT NULL")
    sizes = _hard_sizes(prepared)
    found = materialize(_hardest(prepared, sizes, mode, tile_rows), "hardest")
    ties = (
        _hard_tiles(prepared.join(found, ["batch_id", "id"]), sizes)
        .mapInArrow(_hard_pass(_Ties, tile_rows, strict), _TIES_SCHEMA)
        .groupBy("batch_id", "id")
        .agg(*[F.sum(c).alias(c) for c in ("n_pos", "n_masked", "n_neg", "n_max")])
    )
    extremes = found.join(ties, ["batch_id", "id"])
    tiles = _hard_tiles(prepared.join(extremes, ["batch_id", "id"]), sizes)
    parts = tiles.mapInArrow(_hard_pass(_HardSlopes, tile_rows, strict), _HARD_GRAD_SCHEMA)
    zero = F.lit(0.0)
    moved = parts.select(
        "id", F.col("uses").alias("weight"), zero.alias("loss"), zero.alias("active"), zero.alias("valid"), "grad"
    )
    size = F.size("encode")
    own = df.select("batch_id", "id", "encode").join(found, ["batch_id", "id"]).select(
        F.col("id").cast("bigint").alias("id"),
        F.col("active").alias("weight"),
        (softplus(F.col("dist")) * F.col("active")).alias("loss"),
        "active",
        F.lit(1.0).alias("valid"),
        F.array_repeat(F.lit(0.0), size).alias("grad"),
    )
    return moved.unionByName(own)
