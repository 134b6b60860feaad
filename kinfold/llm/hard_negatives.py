"""Hard negatives by slot-decomposed selection.

A positive with score p takes negatives with scores between 50 % and 95 % of p.
The windows of an anchor's positives overlap, so they are not searched one by
one: their upper limits, in descending order, cut the scores into disjoint
slots. Tasks keep the best ``take`` rows of each slot only, however many rows
they read, and the lists of all tasks are merged per slot. The best rows below
a positive's upper limit are then the best of its slot and all lower ones: one
descending suffix merge over at most ``positives * take`` entries answers every
window of the anchor.

Anchors are a stated query set; they meet all rows in ``grid``, where rows are
dealt by row number, so a label with a third of all rows is spread like any
other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import stored, table
from kinfold.llm.grid import Best, Queries, Rows, leaders, query_grid, whole_vectors

SCALE = 256
EVERY = 50
POSITIVES = 5
TAKE = 3
LOW, HIGH = 50, 95  # window of a negative's score, in hundredths of the positive's
_FOUND = "row long, id long, slot long, other long, score long"


def _batch(queries: Queries, strip: slice, key: np.ndarray, slots: int, best: Best) -> pa.RecordBatch:
    at = strip.start + key // slots
    arrays = (queries.row[at], queries.id[at], key % slots, best.id, best.score)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["row", "id", "slot", "other", "score"])


class _Positives:
    """Of each anchor the best other rows of its label."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.best = [Best(s.stop - s.start, k) for s in queries.strips]

    def rows(self, rows: Rows) -> None:
        labels = rows.info[:, 0]
        order = np.argsort(labels, kind="stable")
        of_label = dict(zip(*_groups(labels[order], order)))
        for strip, best in zip(self.queries.strips, self.best):
            own = self.queries.info[strip, 0]
            for label in np.unique(own):
                near = of_label.get(label)
                if near is None:
                    continue
                at = np.flatnonzero(own == label)
                scores = rows.q[strip][at] @ rows.v[near].T
                other = self.queries.row[strip][at][:, None] != rows.row[near][None, :]
                i, j = leaders(scores, other, best.least[at], self.k)
                best.add(at[i], scores[i, j], rows.id[near[j]])

    def done(self) -> Iterator[pa.RecordBatch]:
        for strip, best in zip(self.queries.strips, self.best):
            yield _batch(self.queries, strip, best.key, 1, best)


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[starts].tolist(), np.split(values, starts[1:])


class _Slots:
    """Of each anchor and slot the best rows of other labels.

    ``info`` of an anchor: its label, the least score of its windows, then the
    upper limits in descending order, the last one repeated up to the width.
    """

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.slots = queries.info.shape[1] - 2
        self.best = [Best((s.stop - s.start) * self.slots, k) for s in queries.strips]

    def rows(self, rows: Rows) -> None:
        for strip, best in zip(self.queries.strips, self.best):
            info = self.queries.info[strip]
            scores = rows.q[strip] @ rows.v.T
            limits = info[:, 1:].astype(scores.dtype)
            if (limits.astype(np.int64) != info[:, 1:]).any():
                scores, limits = scores.astype(np.int64), info[:, 1:]
            wanted = (info[:, :1] != rows.info[:, 0][None, :]) & (scores >= limits[:, :1])
            lists = np.arange(len(info)) * self.slots
            for slot in range(self.slots):
                inside = wanted & (scores <= limits[:, 1 + slot, None])
                if slot + 1 < self.slots:
                    inside &= scores > limits[:, 2 + slot, None]
                i, j = leaders(scores, inside, best.least[lists + slot], self.k)
                best.add(lists[i] + slot, scores[i, j], rows.id[j])

    def done(self) -> Iterator[pa.RecordBatch]:
        for strip, best in zip(self.queries.strips, self.best):
            yield _batch(self.queries, strip, best.key, self.slots, best)


def _first(found: DataFrame, keys: list[str], k: int, rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    rows: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    take: int = TAKE,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` has vec_id, embedding and label. Anchors are the rows whose id is
    divisible by ``every``; an anchor's positives are its best other rows of
    the same label, its negatives rows of another label whose score lies from
    ``low`` to ``high`` hundredths of the positive's, both ends included. Higher
    scores come first, ties by smaller id. Windows that hold fewer rows than
    ``take`` return all of them, and none if empty, as below a positive of a
    negative score. Rows with a null id or label, or with a vector that is
    null, empty or holds a null or non-finite component, take no part. Rows
    that share an id are rows of their own. Vectors of different lengths are
    compared over their shared leading components. An empty table gives an
    empty result; other columns are ignored.
    """
    vectors = whole_vectors(rows, scale, "label")
    known = vectors.select("row", "id", F.array("label").alias("info"), "v")
    anchors = vectors.where(F.col("id") % every == 0)
    asked = anchors.select("row", "id", F.array("label").alias("info"), "v")
    found = query_grid(asked, known, lambda q: _Positives(q, positives), _FOUND)
    best = stored(_first(found, ["row"], positives, "place").drop("slot"), "positives")

    # Whole bounds of the windows: low * p <= 100 * n <= high * p.
    upper = F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    lower = F.expr(f"({low} * score + pmod(-{low} * score, 100)) div 100")
    windows = best.withColumn("upper", upper).withColumn("lower", lower).where("lower <= upper")
    limits = windows.groupBy("row").agg(
        F.min("lower").alias("least"), F.sort_array(F.collect_set("upper"), asc=False).alias("limits")
    )
    limits = stored(limits, "limits")  # written first, so that the joins on it can be split
    padding = F.array_repeat(F.element_at("limits", -1), positives - F.size("limits"))
    asked = anchors.join(limits, "row").select(
        "row", "id", F.concat(F.array("label", "least"), "limits", padding).alias("info"), "v"
    )
    asked = stored(asked, "anchors")
    found = query_grid(asked, known, lambda q: _Slots(q, take), _FOUND)
    slots = stored(_first(found, ["row", "slot"], take), "slots").select(
        "row", "slot", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")
    )

    # The suffix of slots from the positive's own downwards, cut at the window's lower end.
    slotted = windows.join(limits, "row").withColumn("own", F.array_position("limits", F.col("upper")) - 1)
    slotted = slotted.select(
        "row", "place", "own", "lower", F.col("id").alias("anchor_id"), F.col("other").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    merged = slotted.join(slots, "row").where("slot >= own AND negative_score >= lower")
    order = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score",
    )


def relabelled(rows: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """Rows whose id is divisible by ``every`` with the next label."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same,
             CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.rid <> r.rid),
p AS (SELECT anchor, anchor_id, other AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS place
      FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
            AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
