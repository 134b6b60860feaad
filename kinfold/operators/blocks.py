"""Block pairs: bounded tiles of an all-pairs comparison.

Rows are hashed into blocks, and a block is packed into one row. Every unordered
pair of blocks is a row of a cross join of the packed blocks with themselves. A
task of that join reads its left and right blocks again from the shuffle that
dealt them, so a row is shuffled a fixed number of times, however many blocks it
meets. A task keeps running totals over its tiles, so scores are reduced where
they are computed and pairs are never shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import ship

BLOCK_BYTES = 16 << 20  # values of one side of a tile
_DENSE_BYTES = 4 << 20  # the same where all vectors are dense, which large tiles make no faster
_RIGHT_BYTES = 64 << 20  # right blocks that a task of the cross join holds
STRIP_ROWS = 1024  # rows scored at once inside a tile
_SCORES = 1 << 20  # scores held at once
_DENSE_SHARE = 0.008  # of the pairs, above which a column is multiplied as dense
_DENSE_CELLS = 1 << 22  # right cells made dense at once
_MIN_COLUMNS = 64
_PRODUCTS = 1 << 16  # products read from lists at once
_TABLE = 1 << 22  # column numbers above are numbered anew
_MIN_ROWS = 64
_TILES_PER_TASK = 4  # so that tasks end together
_TASKS_PER_CORE = 3


def measured(df: DataFrame) -> tuple[int, int]:
    """Number of rows, and bytes of their arrays, in one pass."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    held = F.lit(0)
    for name in arrays:
        held = held + F.greatest(F.size(name), F.lit(0))
    n, values = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    return n, 8 * values


def rows_per_block(n_rows: int, n_bytes: int, block_bytes: int | None = None) -> int:
    return max(_MIN_ROWS, (block_bytes or BLOCK_BYTES) * n_rows // max(n_bytes, 1))


def tasks_of(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def block_count(n_rows: int, tasks: int, block_rows: int) -> int:
    """Blocks small enough for a task and many enough to occupy the tasks."""
    for_memory = math.ceil(n_rows / block_rows)
    for_tasks = min(math.ceil(math.sqrt(2 * _TILES_PER_TASK * tasks)), math.ceil(n_rows / _MIN_ROWS))
    return max(for_memory, for_tasks, 1)


def packed(df: DataFrame, by: list[str], id_col: str, parts: int) -> DataFrame:
    """``(by..., _rows)``: the rows of each ``by`` in id order, as one value."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in runs(batches, "_run"):
            sink = pa.BufferOutputStream()
            rows = table.drop_columns([*by, "_run"])
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            values = [table.column(c).slice(0, 1).combine_chunks() for c in by]
            yield pa.RecordBatch.from_arrays([*values, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*by, "_rows"])

    key = F.col(by[0]) if len(by) == 1 else F.xxhash64(*by)
    dealt = df.withColumn("_run", key).repartitionById(parts, F.pmod("_run", F.lit(parts)).cast("int"))
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "_rows binary"])
    return dealt.sortWithinPartitions("_run", *by, id_col).mapInArrow(pack, schema)


def crossed(blocks: DataFrame, key: str, n_blocks: int, n_bytes: int, wanted=None, group: str | None = None) -> DataFrame:
    """The pairs of packed blocks for which ``wanted(left key, right key)``, as ``(_l, _r, _left, _right)``.

    A task holds a part of the blocks, bounded by bytes, as right ones and reads
    its left ones as a stream; for one left block it meets all its right ones.
    Blocks of different ``group`` do not meet. The keys of a group follow each
    other, so a left block meets its group in as few tasks as hold it.
    """
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    rights = max(1, min(n_blocks, math.ceil(n_bytes / _RIGHT_BYTES)))
    lefts = max(1, min(n_blocks, math.ceil(_TASKS_PER_CORE * cores / rights)))
    kept = [] if group is None else [group]

    def dealt(parts: int, part, k: str, rows: str, renamed: str) -> DataFrame:
        columns = [F.col(key).alias(k), F.col("_rows").alias(rows), *[F.col(g).alias(renamed) for g in kept]]
        return blocks.repartitionById(parts, part.cast("int")).select(*columns)

    by_turn = lambda parts: F.pmod(F.col(key), F.lit(parts))
    in_order = F.floor(F.col(key) * F.lit(rights) / F.lit(n_blocks))
    left = dealt(lefts, by_turn(lefts), "_l", "_left", "_lg")
    right = dealt(rights, in_order if kept else by_turn(rights), "_r", "_right", "_rg")
    on = F.col("_lg") == F.col("_rg") if kept else wanted(F.col("_l"), F.col("_r"))
    return left.hint("shuffle_replicate_nl").join(right, on).select("_l", "_r", "_left", "_right")


def block_pairs(df: DataFrame, id_col: str, block_rows: int | None = None) -> DataFrame:
    """Each unordered pair of blocks once, for ``tiles`` to read in the tasks.

    A block meets itself too. On which side of the join the lower block of a
    pair stands alternates, so that tasks have about the same number of tiles.
    """
    spark = df.sparkSession
    ship(spark)
    n_rows, n_bytes = measured(df)
    sparse = any(c.startswith("idx") or c == "terms" for c in df.columns)
    bounded = block_rows or rows_per_block(n_rows, n_bytes, BLOCK_BYTES if sparse else _DENSE_BYTES)
    k = block_count(n_rows, tasks_of(spark), bounded)
    blocks = packed(df.withColumn("_block", F.pmod(F.xxhash64(F.col(id_col)), F.lit(k))), ["_block"], id_col, k)
    return crossed(blocks, "_block", k, n_bytes, lambda l, r: F.when((l + r) % 2 == 0, l <= r).otherwise(l > r))


def row_grid(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Tiles of some ``left`` rows with all ``right`` rows, for ``tiles`` to read.

    Left rows are few: they are copied to every part of the right rows, which
    are copied once for each block of left rows, that is, once if these fit.
    """
    spark = right.sparkSession
    ship(spark)
    (n_left, b_left), (n_right, b_right) = measured(left), measured(right)
    lefts = max(1, math.ceil(n_left / rows_per_block(n_left, b_left)))
    for_memory = math.ceil(n_right / rows_per_block(n_right, b_right))
    rights = max(1, for_memory, min(math.ceil(tasks_of(spark) / lefts), math.ceil(n_right / _MIN_ROWS)))

    def dealt(df: DataFrame, own: int, other: int, side: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other - 1).cast("bigint")))
        block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(own))
        copies = df.withColumn("_own", block).withColumn("_other", every).withColumn("_side", F.lit(side))
        l, r = ("_own", "_other") if side == 0 else ("_other", "_own")
        return copies.withColumn("_pair", F.col(l) * rights + F.col(r)).drop("_own", "_other")

    parts = min(lefts * rights, tasks_of(spark))
    both = dealt(left, lefts, rights, 0).unionByName(dealt(right, rights, lefts, 1))
    return both.repartitionById(parts, F.pmod(F.col("_pair"), F.lit(parts)).cast("int")).sortWithinPartitions(
        "_pair", "_side", id_col
    )


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows with one key, joined across batch borders."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if current is not None and keys[start] != current:
                yield current, pa.Table.from_batches(held).combine_chunks()
                held = []
            current = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def lists(table: pa.Table, name: str, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (offsets, flat values)."""
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(sizes))]).astype(np.int64)
    return offsets, col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


class Rows:
    """The vectors of some rows, dense (``vec``) or sparse (``idx``/``val``)."""

    def __init__(self, table: pa.Table):
        self.n = table.num_rows
        self.sparse = "idx" in table.column_names
        if self.sparse:
            self.offsets, self.idx = lists(table, "idx", np.int64)
            self.val = lists(table, "val")[1]
        else:
            self.offsets, flat = lists(table, "vec")
            self.dense = flat.reshape(self.n, -1) if self.n else flat.reshape(0, 0)

    @classmethod
    def of(cls, offsets: np.ndarray, idx: np.ndarray, val: np.ndarray) -> Rows:
        """Sparse rows from their parts."""
        out = cls.__new__(cls)
        out.n, out.sparse, out.offsets, out.idx, out.val = len(offsets) - 1, True, offsets, idx, val
        return out

    def entry_rows(self) -> np.ndarray:
        """The row of each entry of sparse rows."""
        return np.repeat(np.arange(self.n), np.diff(self.offsets))

    def same_index(self, other: Rows) -> bool:
        if not other.sparse:
            return False
        return self is other or (np.array_equal(self.offsets, other.offsets) and np.array_equal(self.idx, other.idx))

    def even(self) -> np.ndarray | None:
        """The one value of each row's entries, or nothing if a row has several."""
        if not hasattr(self, "_even"):
            one = np.ones(self.n)
            filled = np.flatnonzero(np.diff(self.offsets))
            one[filled] = self.val[self.offsets[filled]]
            self._even = one if np.array_equal(self.val, np.repeat(one, np.diff(self.offsets))) else None
        return self._even

    def densify(self, start: int, end: int, columns: np.ndarray) -> np.ndarray:
        """Rows start..end as a dense matrix over the given ascending columns."""
        out = np.zeros((end - start, len(columns)))
        if not len(columns):
            return out
        lo, hi = self.offsets[start], self.offsets[end]
        idx = self.idx[lo:hi]
        row = np.repeat(np.arange(end - start), np.diff(self.offsets[start : end + 1]))
        at = np.minimum(np.searchsorted(columns, idx), len(columns) - 1)
        hit = columns[at] == idx
        out[row[hit], at[hit]] = self.val[lo:hi][hit]
        return out


def dot_strips(left: Rows, right: Rows, strip: int = STRIP_ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """Dot products of all left rows with all right rows, a strip at a time."""
    for start, (score,) in kind_strips([left], [right], strip):
        yield start, score


def kind_strips(
    lefts: list[Rows], rights: list[Rows], strip: int = STRIP_ROWS
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The same for several kinds of vectors of the same rows; sparse kinds with equal indices are read together."""
    n_left, n_right = lefts[0].n, rights[0].n
    if n_left == 0 or n_right == 0:
        return
    strip = max(1, min(strip, _SCORES // n_right))
    groups: list[list[int]] = []
    for n, (l, r) in enumerate(zip(lefts, rights)):
        group = next((g for g in groups if l.sparse and l.same_index(lefts[g[0]]) and r.same_index(rights[g[0]])), None)
        if group is None:
            groups.append([n])
        else:
            group.append(n)
    tiles_of = [SparseTile([lefts[n] for n in g], [rights[n] for n in g]) if lefts[g[0]].sparse else None for g in groups]
    for s in range(0, n_left, strip):
        e = min(s + strip, n_left)
        out: list = [None] * len(lefts)
        for g, tile in zip(groups, tiles_of):
            found = [lefts[g[0]].dense[s:e] @ rights[g[0]].dense.T] if tile is None else tile.strip(s, e)
            for n, score in zip(g, found):
                out[n] = score
        yield s, out


def _compact(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Column numbers of both sides that are small enough for tables, and their bound."""
    top = 1 + int(max(left.max(initial=-1), right.max(initial=-1)))
    if top <= _TABLE:
        return left, right, top
    every, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    return at[: len(left)], at[len(left) :], len(every)


class SparseTile:
    """Products of sparse rows, of some kinds with equal indices.

    Columns that many pairs share are multiplied as dense matrices. The others
    are read by lists: for each left entry, the right rows that have its column.
    Kinds whose rows have one value each are counted, and scaled at the end.
    """

    def __init__(self, lefts: list[Rows], rights: list[Rows]):
        left, right = lefts[0], rights[0]
        l, r, top = _compact(left.idx, right.idx)
        n_l, n_r = np.bincount(l, minlength=top), np.bincount(r, minlength=top)
        share = n_l.astype(float) * n_r
        dense = share > _DENSE_SHARE * left.n * right.n
        listed = (share > 0) & ~dense
        self.n = right.n
        self.columns = int(dense.sum())
        self.width = max(_MIN_COLUMNS, _DENSE_CELLS // right.n)
        place = np.cumsum(dense) - 1
        self.even = [a.even() is not None and b.even() is not None for a, b in zip(lefts, rights)]
        self.scales = [(a.even(), b.even()) if e else None for a, b, e in zip(lefts, rights, self.even)]
        # Dense entries, left and right: rows, columns and the values of each kind.
        self.parts = []
        for side, cols, of_kinds in ((left, l, lefts), (right, r, rights)):
            at = np.flatnonzero(dense[cols])
            row = side.entry_rows()[at]
            values = [np.ones(len(at), np.float32) if e else k.val[at] for k, e in zip(of_kinds, self.even)]
            self.parts.append((np.searchsorted(row, np.arange(side.n + 1)), row, place[cols[at]], values))
        self.right_dense = None if self.columns > self.width else self._right(0)
        # Listed entries: the right ones by column, the left ones row by row.
        at = np.flatnonzero(listed[r])
        key = r[at].astype(np.uint16) if top <= 1 << 16 else r[at]  # short keys are sorted by radix
        at = at[np.argsort(key, kind="stable")]
        self.list_rows = right.entry_rows()[at]
        self.list_values = [None if e else k.val[at] for k, e in zip(rights, self.even)]
        sizes = np.where(listed, n_r, 0)
        starts = np.cumsum(sizes) - sizes
        at = np.flatnonzero(listed[l])
        self.row = left.entry_rows()[at]
        self.bounds = np.searchsorted(self.row, np.arange(left.n + 1))
        self.starts, self.sizes = starts[l[at]], sizes[l[at]]
        self.values = [None if e else k.val[at] for k, e in zip(lefts, self.even)]
        self.order = np.arange(_PRODUCTS + int(sizes.max(initial=0)))

    def _block(self, side: int, start: int, end: int, first: int) -> list[np.ndarray]:
        """Rows of a side over some of the dense columns, of each kind."""
        bounds, row, col, values = self.parts[side]
        part = slice(bounds[start], bounds[end])
        row, col, values = row[part] - start, col[part] - first, [v[part] for v in values]
        width = min(self.width, self.columns - first)
        if self.columns > self.width:
            here = (col >= 0) & (col < width)
            row, col, values = row[here], col[here], [v[here] for v in values]
        out = []
        for v in values:
            cells = np.zeros((end - start, width), v.dtype)
            cells[row, col] = v
            out.append(cells)
        return out

    def _right(self, first: int) -> list[np.ndarray]:
        return self._block(1, 0, self.n, first)

    def strip(self, start: int, end: int) -> list[np.ndarray]:
        out = [np.empty((end - start, self.n), np.float32 if e else np.float64) for e in self.even]
        for first in range(0, max(self.columns, 1), self.width):
            right = self.right_dense or self._right(first)
            for score, a, b in zip(out, self._block(0, start, end, first), right):
                if first:
                    score += a @ b.T
                else:
                    np.matmul(a, b.T, out=score)
        self._listed(start, end, out)
        for k, scale in enumerate(self.scales):
            if scale is not None:
                out[k] = out[k] * scale[0][start:end, None]
                out[k] *= scale[1]
        return out

    def _listed(self, start: int, end: int, out: list[np.ndarray]) -> None:
        lo, hi = self.bounds[start], self.bounds[end]
        total = np.cumsum(self.sizes[lo:hi])
        if not len(total):
            return
        cuts = np.searchsorted(total, np.arange(_PRODUCTS, total[-1], _PRODUCTS), "left") + 1
        cuts = np.unique(np.concatenate([[0], cuts, [len(total)]])) + lo
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sizes, first, last = self.sizes[a:b], self.row[a], self.row[b - 1] + 1
            at = np.repeat(self.starts[a:b] - (np.cumsum(sizes) - sizes), sizes)
            at += self.order[: len(at)]
            # Take with clipping is the fast one; all positions are in range.
            key = self.list_rows.take(at, mode="clip")
            key += np.repeat((self.row[a:b] - first) * self.n, sizes)
            cells = (last - first) * self.n
            for k, score in enumerate(out):
                weight = None
                if not self.even[k]:
                    weight = self.list_values[k].take(at, mode="clip")
                    weight *= np.repeat(self.values[k][a:b], sizes)
                sums = np.bincount(key, weight, cells).reshape(-1, self.n)
                np.add(score[first - start : last - start], sums, out=score[first - start : last - start], casting="same_kind")


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """Left rows, right rows, and whether both are the same block."""
    side = column(table, "_side")
    if len(side) and side[0] == 2:
        return table, table, True
    cut = int(np.searchsorted(side, 1))
    return table.slice(0, cut), table.slice(cut), False


def opened(batch: pa.RecordBatch, name: str, i: int) -> pa.Table:
    """The rows of a packed block."""
    return pa.ipc.open_stream(batch.column(name)[i].as_buffer()).read_all().combine_chunks()


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table, bool]]:
    """Left rows, right rows, and whether both are the same block, of each tile; of two blocks the lower is left."""
    first = next(batches, None)
    if first is None:
        return
    batches = itertools.chain([first], batches)
    if "_left" not in first.schema.names:
        for _, table in runs(batches, "_pair"):
            yield sides(table)
        return
    for batch in batches:
        for i in range(batch.num_rows):
            l, r = batch.column("_l")[i].as_py(), batch.column("_r")[i].as_py()
            left = opened(batch, "_left", i)
            right = left if l == r else opened(batch, "_right", i)
            yield (left, right, l == r) if l <= r else (right, left, False)
