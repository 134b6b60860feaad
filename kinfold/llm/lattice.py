"""Embedding near-duplicates by lattice hashing on E8.

Equal vectors are one node with a count. A node's unit vector is projected at
random to eight dimensions a block and decoded to the nearest point of the
lattice E8; the points of a table's blocks name its home cell. Neighbouring
cells are probed in the order of their distance: a node stands in its home cell
and in those of the next nearest points, in several tables. Nodes that meet in
a cell are compared by cosine in double precision.

A pair may meet in several cells. It counts in the first one both stand in,
which each task can tell from the nodes' own cells, so links are counted where
they are found: a task sends counts and the edges of a spanning forest, never
pairs. A cell with more than ``TILE`` nodes is cut into tiles, every pair of
which is a task's work of its own.

With more rows a table takes more blocks, so that cells stay small, and there
are more tables, so that the recall stays; see ``layout``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, ship, stored, table
from kinfold.llm.components import components
from kinfold.operators.ordering import lookup_join

COSINE = 0.95
WIDTH = 0.5  # scale of the lattice for unit vectors
TILE = 4096
SEED = 11
_STRIP = 512  # rows compared at once
_PAIRS = 200_000  # pairs looked up at once
_SPARSITY = 200  # a block meets about one random pair in so many
_FIRST = 2**19  # rows up to which one block keeps cells small


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or all of one half with an even number below zero."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


_MINIMAL = _minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum."""
    near = np.rint(x)
    off = x - near
    at, worst = np.arange(len(x)), np.abs(off).argmax(1)
    odd = near.sum(1) % 2 != 0
    near[at[odd], worst[odd]] += np.where(off[at[odd], worst[odd]] >= 0, 1.0, -1.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: whole points of even sum, or those moved by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def layout(n: int) -> tuple[int, int, int]:
    """Tables, blocks a table and probes a table for ``n`` vectors."""
    blocks = 1 + max(0, math.ceil(math.log(max(1, n) / _FIRST, _SPARSITY)))
    return 3 * blocks - 1, blocks, 4 * blocks


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, seed: int = SEED) -> np.ndarray:
    """``(rows, tables, probes)``: 64-bit names of the cells of unit vectors, the home cell first."""
    n, width = unit.shape
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        draw = np.random.default_rng((seed, width, t))
        cost, name = np.zeros((n, 1)), np.zeros((n, 1), np.uint64)
        for _ in range(blocks):
            y = unit @ draw.standard_normal((width, 8)) / (math.sqrt(8) * WIDTH)
            factors = draw.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            home = nearest_point(y)
            away = 2 - 2 * ((y - home) @ _MINIMAL.T)  # how much farther the neighbours are
            near = np.argpartition(away, probes - 1, axis=1)[:, : probes - 1]
            points = np.concatenate([home[:, None], home[:, None] + _MINIMAL[near]], axis=1)
            more = np.concatenate([np.zeros((n, 1)), np.take_along_axis(away, near, 1)], axis=1)
            code = (np.rint(2 * points).astype(np.int64).view(np.uint64) * factors).sum(2, dtype=np.uint64)
            # The nearest cells are those of the least sums over the blocks.
            cost = (cost[:, :, None] + more[:, None, :]).reshape(n, -1)
            name = (name[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + code[:, None, :]).reshape(n, -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, name = np.take_along_axis(cost, keep, 1), np.take_along_axis(name, keep, 1)
        out[:, t] = name.view(np.int64)
    return out


def _packed(v: np.ndarray) -> bytes:
    """One byte for the width of a component, then the components: four bytes each where that is exact."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return b"\x04" + short.tobytes() if (short == v).all() else b"\x08" + v.astype("<f8").tobytes()


def _length(packed: bytes) -> int:
    return (len(packed) - 1) // packed[0]


def _units(packed: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to the longest."""
    if len({(len(p), p[0]) for p in packed}) == 1:
        flat = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        v = np.ascontiguousarray(flat[:, 1:]).view(f"<f{packed[0][0]}").astype(float)
    else:
        v = np.zeros((len(packed), max(map(_length, packed))))
        for row, p in zip(v, packed):
            row[: _length(p)] = np.frombuffer(p, f"<f{p[0]}", offset=1)
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the vectors that can have a cosine, null for the others."""
    for batch in batches:
        keys, vectors = [], []
        for x in batch.column("x").to_pylist():
            v = None if not x or None in x else np.array(x, "<f8") + 0.0
            if v is None or not np.isfinite(v).all() or not v.any():
                keys.append(None)
                vectors.append(None)
            else:
                vectors.append(_packed(v))
                keys.append(hashlib.sha256(vectors[-1]).digest())
        columns = [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "key", "v"])


def _coded(batches: Iterator[pa.RecordBatch], tables: int, blocks: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v").to_pylist()
        sizes = np.array([_length(x) for x in v], np.int64)
        codes = np.empty((len(v), tables * probes), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            # Vectors of different lengths have cells of their own.
            codes[at] = cells(_units([v[i] for i in at]), tables, blocks, probes).reshape(len(at), -1) ^ int(size)
        flat = pa.array(codes.ravel(), pa.int64())
        offsets = pa.array(np.arange(len(v) + 1) * (tables * probes), pa.int32())
        columns = [*(batch.column(c) for c in ("node", "n", "v")), pa.ListArray.from_arrays(offsets, flat)]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "v", "codes"])


class _Tile:
    """Nodes of a cell: two sides, or one that is compared with itself."""

    def __init__(self, rows: pa.Table, tables: int):
        self.node, self.n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        codes = rows.column("codes").combine_chunks()
        self.codes = codes.flatten().to_numpy().reshape(len(self.node), tables, -1)
        packed = rows.column("v").to_pylist()
        self.unit, self.length = _units(packed), np.array([_length(p) for p in packed])
        side = rows.column("side").to_numpy()
        self.cell = rows.column("cell")[0].as_py()
        self.same = side[0] == 2
        self.cut = len(side) if self.same else int(np.searchsorted(side, 1))
        self.table = int(np.flatnonzero((self.codes[0] == self.cell).any(1))[0])

    def _pairs(self, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        right = 0 if self.same else self.cut
        for start in range(0, self.cut, _STRIP):
            strip = self.unit[start : min(start + _STRIP, self.cut)]
            i, j = np.nonzero(strip @ self.unit[right:].T >= cosine)
            i, j = i + start, j + right
            equal = self.length[i] == self.length[j]  # cells of other lengths may have the same name
            i, j = i[equal], j[equal]
            if self.same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), _PAIRS):
                yield i[at : at + _PAIRS], j[at : at + _PAIRS]

    def _met_first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs that stand together in no cell before this one."""
        here = np.ones(len(i), bool)
        for t in range(self.table + 1):
            a, b = self.codes[i, t][:, :, None], self.codes[j, t][:, None, :]
            if t < self.table:
                here &= ~(a == b).any((1, 2))
            else:
                here &= np.where(a == b, a, np.iinfo(np.int64).max).min((1, 2)) == self.cell
        return here

    def links(self, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``(node, root, links)``: the least node of a node's links in this tile, and their number."""
        count, root = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        for i, j in self._pairs(cosine):
            here = self._met_first(i, j)
            i, j = i[here], j[here]
            np.add.at(count, i, self.n[j])
            np.add.at(count, j, self.n[i])
            while True:
                a, b = root[i], root[j]
                if (a == b).all():
                    break
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
        found = np.flatnonzero(count)
        return self.node[found], self.node[root[found]], count[found]


def _compared(batches: Iterator[pa.RecordBatch], tables: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of each tile; rows come sorted by (cell, low, high, side)."""

    def out(found: list) -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)]
        return pa.RecordBatch.from_arrays(arrays, names=["node", "root", "links"])

    def tiles() -> Iterator[pa.Table]:
        held, current = [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("cell", "low", "high")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=0) != 0).any(1)) + 1).tolist(), len(marks)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                mark = tuple(marks[start])
                if held and mark != current:
                    yield pa.Table.from_batches(held)
                    held = []
                current = mark
                held.append(batch.slice(start, end - start))
        if held:
            yield pa.Table.from_batches(held)

    found, size = [], 0
    for rows in tiles():
        if rows.num_rows < 2:
            continue
        one = _Tile(rows, tables).links(cosine)
        if len(one[0]):
            found.append(one)
            size += len(one[0])
        if size > 50_000:
            yield out(found)
            found, size = [], 0
    if found:
        yield out(found)


def _entries(nodes: DataFrame, tile: int) -> DataFrame:
    """Nodes once per cell and tile, as ``(cell, low, high, side)``."""
    sizes = nodes.select(F.explode("codes").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    large = stored(sizes.where(F.col("size") > tile).select("cell", F.ceil(F.col("size") / tile).alias("k")), "large-cells")
    every = nodes.select("node", "n", "v", "codes", F.explode("codes").alias("cell"))
    keyed = lookup_join(every, large, "cell", "left", salt_on="node", stored=True)
    keyed = keyed.withColumn("k", F.coalesce("k", F.lit(1)).cast("long"))
    own, other = F.pmod(F.xxhash64("node"), F.col("k")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    dealt = keyed.withColumn("own", own).withColumn("other", other)
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.select(
        "node", "n", "v", "codes", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        side.cast("int").alias("side"),
    )


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, tables: int | None = None, blocks: int | None = None,
    probes: int | None = None, tile: int = TILE,
) -> DataFrame:
    """``(vec_id, n_links, component_id)``, a row per row of ``rows(vec_id, embedding)``.

    Pairs found with that cosine or more are linked, none below it. n_links
    counts the other rows that a row is linked with, component_id is the
    smallest vec_id reachable. Rows with equal vectors are linked; rows that
    share an id are rows of their own. Vectors that are null, empty, all zero,
    or hold a null or non-finite component link with nothing, and vectors of
    different lengths not with each other. A null vec_id counts as a row, but
    names no component unless all ids in it are null. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    known = materialize(given.mapInArrow(_prepared, "vec_id long, key binary, v binary"), "vectors")
    nodes = known.where("key IS NOT NULL").groupBy("key").agg(
        F.min("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id")
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    chosen = layout(nodes.count())
    tables, blocks, probes = (given or own for given, own in zip((tables, blocks, probes), chosen))
    coded = nodes.select("node", "n", "v").mapInArrow(
        lambda it: _coded(it, tables, blocks, probes), "node long, n long, v binary, codes array<long>"
    )
    coded = materialize(coded, "cells")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "low", "high"]
    dealt = _entries(coded, tile).repartition(tasks, *order).sortWithinPartitions(*order, "side")
    found = dealt.mapInArrow(lambda it: _compared(it, tables, cosine), "node long, root long, links long")
    found = stored(found, "links")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.select("key", "node", "n", "least_id").join(linked, "node", "left")
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stored(classes, "classes")
    least = stored(classes.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    # Written first, so that the joins with hot roots and keys can be split.
    classes = stored(
        classes.join(least, "root").select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
        ),
        "classes",
    )
    joined = known.select("vec_id", "key").join(classes, "key", "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op11_embeddings(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.withColumn("kept", kept)


# Every pair by its definition: the hashing finds those of the tables this is run on.
ORACLE = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v,
                  embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS known FROM embeddings),
l AS (SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b
      ON a.rid <> b.rid AND a.known AND b.known AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
    WITH RECURSIVE r(a, b) AS (SELECT rid, rid FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT * FROM r),
c AS (SELECT reach.a AS rid, min(e.vec_id) AS component_id FROM reach JOIN e ON e.rid = reach.b GROUP BY reach.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM e JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
