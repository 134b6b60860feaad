"""Exact top-k inner products in three phases with a uniform threshold.

Vectors become whole numbers, and their components are cut into ``PARTS``
parts; a part's local score is the inner product over its components, and a
score is the sum of the local ones.

1. Per query, each part's best local scores are gathered and those candidates
   scored. The k-th best of their scores, over all tasks, is a safe cutoff.
2. The cutoff c goes to all tasks as a column of the queries. A candidate with
   a score of c or more has a local score of at least c / PARTS in some part,
   so entries with such a local score suffice.
3. The scores of those entries are resolved over the remaining parts, and what
   reaches the cutoff is merged.

The cutoff is a pair of score and id, so a third of all rows with one vector
does not pass it together. Queries meet all rows in ``grid``: a task holds some
queries, streams rows past them, and sends at most k entries a query, however
many rows it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import stored, table
from kinfold.llm.grid import QUERY_ROWS, Best, Queries, Rows, query_grid, whole_vectors

K = 20
PARTS = 4
SCALE = 64
_FOUND = "row long, query_id long, vec_id long, score long"


def _local_scores(queries: Queries, rows: Rows, strip: slice, parts: int) -> list[np.ndarray]:
    width = rows.v.shape[1]
    cuts = [slice(width * i // parts, width * (i + 1) // parts) for i in range(parts)]
    return [rows.q[strip, c] @ rows.v[:, c].T for c in cuts]


class _Phase:
    """The best ``k`` entries of each query among those that ``_near`` names."""

    def __init__(self, queries: Queries, k: int, parts: int):
        self.queries, self.k, self.parts = queries, k, parts
        self.best = [Best(s.stop - s.start, k) for s in queries.strips]

    def rows(self, rows: Rows) -> None:
        for strip, best in zip(self.queries.strips, self.best):
            local = _local_scores(self.queries, rows, strip, self.parts)
            i, j = np.nonzero(self._near(local, strip) & (self.queries.row[strip][:, None] != rows.row[None, :]))
            score = sum(s[i, j].astype(np.int64) for s in local)
            keep = self._kept(strip, i, score, rows.id[j])
            best.add(i[keep], score[keep], rows.id[j[keep]])

    def done(self) -> Iterator[pa.RecordBatch]:
        for strip, best in zip(self.queries.strips, self.best):
            at = strip.start + best.key
            arrays = (self.queries.row[at], self.queries.id[at], best.id, best.score)
            names = ["row", "query_id", "vec_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=names)


class _LocalLists(_Phase):
    """Phase 1: candidates that lead some part's list."""

    def _near(self, local: list[np.ndarray], strip: slice) -> np.ndarray:
        heads = min(self.k + 1, local[0].shape[1])  # one more, since a query may lead its own list
        near = np.zeros(local[0].shape, bool)
        for scores in local:
            lead = np.argpartition(-scores, heads - 1, axis=1)[:, :heads]
            np.put_along_axis(near, lead, True, axis=1)
        return near

    def _kept(self, strip: slice, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.ones(len(i), bool)


class _Sufficient(_Phase):
    """Phases 2 and 3: entries above the uniform threshold, resolved and held against the cutoff."""

    def _near(self, local: list[np.ndarray], strip: slice) -> np.ndarray:
        # Local scores are whole numbers, and the largest is not below the mean.
        threshold = -np.floor_divide(-self.queries.info[strip, 0], self.parts).astype(local[0].dtype)[:, None]
        near = local[0] >= threshold
        for scores in local[1:]:
            near |= scores >= threshold
        return near

    def _kept(self, strip: slice, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cut_score, cut_id = self.queries.info[strip, 0][i], self.queries.info[strip, 1][i]
        return (score > cut_score) | ((score == cut_score) & (ids <= cut_id))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(
    rows: DataFrame, every: int = 20, k: int = K, parts: int = PARTS, scale: int = SCALE, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose id is divisible by ``every``.

    ``rows`` has vec_id and embedding. Rows without an id, and vectors that are
    null, empty, or hold a null or non-finite component, take no part. Rows
    that share an id are queries and candidates of their own: each is compared
    with every row but itself. Vectors of different lengths are compared over
    their shared leading components. Ties go to the smaller id. A query with
    fewer than ``k`` candidates returns all of them; an empty table gives an
    empty result; other columns are ignored. Scores beyond 64 bits raise an
    error.
    """
    vectors = whole_vectors(rows, scale)
    known = vectors.select("row", "id", F.array(F.lit(0).cast("long")).alias("info"), "v")
    queries = known.where(F.col("id") % every == 0)
    heads = _ranked(query_grid(queries, known, lambda q: _LocalLists(q, k, parts), _FOUND, query_rows), k)
    last = F.min(F.struct("score", (-F.col("vec_id")).alias("less")))
    cuts = heads.groupBy("row").agg(last.alias("c"), F.count(F.lit(1)).alias("n"))
    cuts = stored(cuts.where(F.col("n") == k).select("row", "c.score", "c.less"), "cutoffs")
    # A query with fewer candidates than k has no cutoff.
    cut_score, cut_id = F.coalesce("score", F.lit(-(1 << 62))), F.coalesce(-F.col("less"), F.lit((1 << 63) - 1))
    asked = queries.join(cuts, "row", "left").select("row", "id", F.array(cut_score, cut_id).alias("info"), "v")
    asked = stored(asked, "queries")
    found = query_grid(asked, known, lambda q: _Sufficient(q, k, parts), _FOUND, query_rows)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark, sf_dir):
    return top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.rid <> c.rid)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 20
"""
