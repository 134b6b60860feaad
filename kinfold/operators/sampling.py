"""Random pairs by their rank, without looking at the other pairs.

Rows are placed in the order of (label, id). A related pair is a pair (i, j),
i < j, of places inside a class; an unrelated one joins a place of a class to a
place before the class. Both kinds are ranked class after class, so a rank
gives its pair by arithmetic: the class whose span of ranks holds it, and the
places from what is left. Distinct random ranks are the first numbers of a
seeded permutation of all ranks, so the work grows with the sample and the
table, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.permutation import permuted, whole_quotient
from kinfold.operators.blocks import lists
from kinfold.operators.ordering import running_totals, sorted_position
from kinfold.operators.similarity import prepared
from kinfold.session import materialize, ship

_LEAST_SPANS = 1024
_MOST_ROWS = 1 << 32  # ranks of their pairs fit 64 bits


def _spans(places: DataFrame) -> DataFrame:
    """``(start, c, related, unrelated)`` of each class: its first place, size, and the first ranks of its pairs."""
    classes = places.groupBy("label").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("c"))
    inside = whole_quotient(F.col("c") * (F.col("c") - 1), F.lit(2))
    summed = running_totals(classes.withColumn("inside", inside), ["start"], {"inside": "to"}, "classes")
    related = F.col("to") - F.col("inside")
    # Of all pairs among the places before the class, those that are not related.
    before = whole_quotient(F.col("start") * (F.col("start") - 1), F.lit(2))
    return materialize(
        summed.select("start", "c", related.alias("related"), (before - related).alias("unrelated")), "classes"
    )


def _later(t: Column) -> Column:
    """The j of the triangle's t-th pair: the largest with ``j * (j - 1) / 2 <= t``."""
    near = F.floor((F.lit(1.0) + F.sqrt(F.lit(8.0) * t.cast("double") + F.lit(1.0))) / F.lit(2.0))
    first = lambda j: whole_quotient(j * (j - F.lit(1)), F.lit(2))
    low = F.when(first(near) > t, near - 1).otherwise(near)  # the root is a double
    return F.when(first(low + 1) <= t, low + 1).otherwise(low)


def _picked(spans: DataFrame, kind: str, total: int, cap: int, seed) -> DataFrame:
    """``(pos_a, pos_b)`` of the sampled ranks of one kind."""
    spark = spans.sparkSession
    wanted = min(cap, total)
    place = permuted(F.col("id"), total, f"{seed}:{kind}") if wanted < total else F.col("id")
    ranks = spark.range(wanted).select(place.alias("rank"))
    size = whole_quotient(F.col("c") * (F.col("c") - 1), F.lit(2)) if kind == "related" else F.col("start") * F.col("c")
    held = spans.select("start", "c", F.col(kind).alias("first"), size.alias("size")).where("size > 0")
    # Ranks and classes meet in equal slices of the ranks: about as many as there are classes.
    slices = max(1, min(max(held.count(), _LEAST_SPANS), wanted))
    width = -(-total // slices)
    of = lambda x: whole_quotient(x, F.lit(width))
    held = held.withColumn("slice", F.explode(F.sequence(of(F.col("first")), of(F.col("first") + F.col("size") - 1))))
    met = ranks.withColumn("slice", of(F.col("rank"))).join(held, "slice")
    met = met.where("rank >= first AND rank < first + size").withColumn("t", F.col("rank") - F.col("first"))
    if kind == "related":
        met = met.withColumn("j", _later(F.col("t")))
        i = F.col("t") - whole_quotient(F.col("j") * (F.col("j") - 1), F.lit(2))
        return met.select((F.col("start") + i).alias("pos_a"), (F.col("start") + F.col("j")).alias("pos_b"))
    return met.select(
        F.pmod("t", "start").alias("pos_a"), (F.col("start") + whole_quotient(F.col("t"), F.col("start"))).alias("pos_b")
    )


def _products(table: pa.Table) -> np.ndarray:
    """Dot products of the vectors a and b of each row."""
    n = table.num_rows
    if "vec_a" in table.column_names:
        (ends, a), (_, b) = lists(table, "vec_a"), lists(table, "vec_b")
        return np.bincount(np.repeat(np.arange(n), np.diff(ends)), a * b, n) if n else np.zeros(0)
    keyed = []
    width = 1 + max(int(lists(table, f"idx_{s}", np.int64)[1].max(initial=0)) for s in "ab")
    for s in "ab":
        ends, idx = lists(table, f"idx_{s}", np.int64)
        keyed.append((np.repeat(np.arange(n), np.diff(ends)) * width + idx, lists(table, f"val_{s}")[1]))
    (ka, va), (kb, vb) = keyed
    both, at_a, at_b = np.intersect1d(ka, kb, True, True)
    return np.bincount(both // width, va[at_a] * vb[at_b], n) if n else np.zeros(0)


def pair_scores(pairs: DataFrame, rows: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    """``(id_a, id_b, keep..., score)``: dot products of given pairs of rows ``(id, idx, val)`` or ``(id, vec)``."""
    ship(pairs.sparkSession)
    values = [c for c in rows.columns if c in ("idx", "val", "vec")]
    for s in "ab":
        side = rows.select(F.col(id_col).alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in values])
        pairs = pairs.join(side, f"id_{s}")
    names = ["id_a", "id_b", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(_products(pa.Table.from_batches([batch])), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), score], names=[*names, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "score double"]))


def capped_sample(
    df: DataFrame,
    id_col: str,
    label: str,
    cap: int = 10_000_000,
    metric: str = "cosine",
    norm: str = "",
    seed: int = 42,
) -> DataFrame:
    """``(id_a, id_b, related, score)``: ``cap`` random pairs of each kind, all of them if there are fewer.

    Rows with a null or negative label are in no pair. Ids are unique.
    """
    known = df.filter(F.col(label) >= 0)
    keys = known.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"))
    places = materialize(sorted_position(keys, [F.col("label"), F.col("id")], "pos", "places"), "places")
    n = places.count()
    if n >= _MOST_ROWS:
        raise ValueError(f"pairs of {n} rows have more ranks than 64 bits")
    spans = _spans(places)
    same = spans.agg(F.coalesce(F.sum(whole_quotient(F.col("c") * (F.col("c") - 1), F.lit(2))), F.lit(0))).first()[0]
    totals = {"related": same, "unrelated": n * (n - 1) // 2 - same}
    picked = None
    for kind, total in totals.items():
        if total:
            part = _picked(spans, kind, total, cap, seed).withColumn("related", F.lit(kind == "related"))
            picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        none = "id_a bigint, id_b bigint, related boolean, score double"
        return df.sparkSession.createDataFrame([], none)
    for s in "ab":
        picked = picked.join(places.select(F.col("pos").alias(f"pos_{s}"), F.col("id").alias(f"id_{s}")), f"pos_{s}")
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    pairs = picked.select(low.alias("id_a"), high.alias("id_b"), "related")
    return pair_scores(pairs, prepared(known, id_col, metric, norm), id_col, ["related"])
