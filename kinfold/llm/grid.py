"""A stated query set against all rows, in tasks that hold queries and stream rows.

Queries are dealt to ``q`` blocks and rows to ``r`` blocks; a task takes one of
each, so a row is copied q times and a query r times. Blocks of queries are
bounded, since a task holds them; blocks of rows are not, since it reads them a
batch at a time. Among the grids with enough tasks, the one that moves the
fewest rows is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import ship, stored

QUERY_ROWS = 16384  # queries a task holds, about
STRIP = 256  # queries whose scores are held at once
_LEAST_ROWS = 512  # rows worth a task
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def whole_vectors(rows: DataFrame, scale: int, label: str | None = None) -> DataFrame:
    """``(row, id, label, v)``, stored: ``floor(scale * x)`` of each component, packed.

    ``row`` numbers the rows of the stored table, so that rows with one vec_id
    keep apart. Rows without an id, or, if asked for, without a label, and
    vectors that are null, empty, or hold a null or non-finite component, are
    left out. Components beyond 64 bits raise an error.
    """
    ship(rows.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = rows.select(
        F.col("vec_id").cast("long").alias("id"),
        (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    kept = kept.where("id IS NOT NULL AND label IS NOT NULL AND size(x) > 0").where(F.forall("x", finite))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_packed(np.floor(scale * np.asarray(x, float))) for x in batch.column("x").to_pylist()]
            columns = [batch.column("id"), batch.column("label"), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "v"])

    packed = kept.mapInArrow(pack, "id long, label long, v binary")
    return stored(packed.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")


def _packed(v: np.ndarray) -> bytes:
    """One byte for the width of a component, then the components."""
    most = np.abs(v).max()
    if most >= float(1 << 62):
        raise ValueError("components too large for whole scores of 64 bits")
    kind = next(k for k in _WIDTHS if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + v.astype(kind).tobytes()


def unpacked(packed: pa.Array) -> np.ndarray:
    """Whole components, a row each, padded with zeros to the longest."""
    values = packed.to_pylist()
    if not values:
        return np.zeros((0, 0), np.int64)
    shapes = {(len(v), v[0]) for v in values}
    if len(shapes) == 1:
        ((size, width),) = shapes
        flat = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), size)
        return np.ascontiguousarray(flat[:, 1:]).view(f"<i{width}").astype(np.int64)
    out = np.zeros((len(values), max((s - 1) // w for s, w in shapes)), np.int64)
    for i, v in enumerate(values):
        one = np.frombuffer(v, f"<i{v[0]}", offset=1)
        out[i, : len(one)] = one
    return out


class Queries:
    """Queries of a task: ``row``, ``id``, ``info`` and their components, in strips."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.row, self.id = (table.column(c).to_numpy() for c in ("row", "id"))
        self.info = np.array(table.column("info").to_pylist(), np.int64).reshape(len(self.row), -1)
        self.v = unpacked(table.column("v"))
        self.most = int(np.abs(self.v).max(initial=0))
        self.strips = [slice(i, min(i + STRIP, len(self.row))) for i in range(0, len(self.row), STRIP)]


class Rows:
    """A batch of rows, cut or padded to the queries' width, with exact types for products."""

    def __init__(self, batch: pa.RecordBatch, queries: Queries):
        self.row, self.id = (batch.column(c).to_numpy() for c in ("row", "id"))
        self.info = np.array(batch.column("info").to_pylist(), np.int64).reshape(len(self.row), -1)
        v = unpacked(batch.column("v"))
        shared = min(v.shape[1], queries.v.shape[1])
        most = queries.most * int(np.abs(v).max(initial=0)) * max(1, shared)
        if most >= 1 << 63:
            raise ValueError("components too large for whole scores of 64 bits")
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.v, self.q = v[:, :shared].astype(self.kind), queries.v[:, :shared].astype(self.kind)


class Best:
    """The ``k`` highest scores of each of ``n`` lists, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.key = self.score = self.id = np.empty(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th score of a full list

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        near = score >= self.least[key]
        if not near.any():
            return
        key = np.concatenate([self.key, key[near]])
        score = np.concatenate([self.score, score[near].astype(np.int64)])
        ids = np.concatenate([self.id, ids[near]])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        full = place == self.k - 1
        self.least[key[full]] = score[full]
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]


def leaders(scores: np.ndarray, wanted: np.ndarray | None, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries that may be among the k highest of their row, ties included."""
    near = scores >= least.astype(scores.dtype)[:, None]
    if wanted is not None:
        near &= wanted
    if scores.shape[1] > 4 * k and near.sum() > 4 * k * len(scores):
        low = np.iinfo(scores.dtype).min if scores.dtype.kind == "i" else -np.inf
        held = np.where(near, scores, np.array(low, scores.dtype))
        near &= scores >= np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    return np.nonzero(near)


def shape(n_queries: int, n_rows: int, tasks: int, query_rows: int = QUERY_ROWS) -> tuple[int, int]:
    """Blocks of queries and of rows: at least ``tasks`` pairs where rows suffice."""
    tasks = max(1, min(tasks, math.ceil(n_rows / _LEAST_ROWS)))
    by_memory = math.ceil(n_queries / query_rows)
    by_moves = round(math.sqrt(n_queries * tasks / max(1, n_rows)))
    q = max(1, by_memory, min(by_moves, n_queries))
    return q, max(1, math.ceil(tasks / q))


def query_grid(
    queries: DataFrame, rows: DataFrame, work: Callable, schema: str, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``work`` on every pair of a block of ``queries`` and a block of ``rows``.

    Both are stored tables of (row, id, info, v). ``work(queries)`` takes the
    ``Queries`` of a task and gives an object with ``rows(batch)``, called with
    each ``Rows``, and ``done()``, whose batches have the ``schema``.
    """
    spark = rows.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    q_blocks, r_blocks = shape(queries.count(), rows.count(), tasks, query_rows)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select("row", "id", "info", "v", F.lit(0).alias("side"), dealt(q_blocks).alias("q"))
    asked = asked.withColumn("r", every(r_blocks))
    read = rows.select("row", "id", "info", "v", F.lit(1).alias("side"), dealt(r_blocks).alias("r"))
    read = read.withColumn("q", every(q_blocks))
    both = asked.unionByName(read).withColumn("task", (F.col("q") * r_blocks + F.col("r")).cast("int")).drop("q", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, state = None, [], None
        for batch in batches:
            marks = 2 * batch.column("task").to_numpy().astype(np.int64) + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                task, side = divmod(int(marks[start]), 2)
                if task != current:
                    if state is not None:
                        yield from state[1].done()
                    current, held, state = task, [], None
                part = batch.slice(start, end - start)
                if side == 0:
                    held.append(part)
                elif held:
                    if state is None:
                        asked = Queries(held)
                        state = asked, work(asked)
                    state[1].rows(Rows(part, state[0]))
        if state is not None:
            yield from state[1].done()

    grid = both.repartitionById(q_blocks * r_blocks, "task").sortWithinPartitions("task", "side")
    return grid.mapInArrow(run, schema)
