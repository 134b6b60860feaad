"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stored


def _stars(pairs: DataFrame) -> DataFrame:
    """Each ``v`` of ``(u, v)`` and ``u`` itself, with the least of u's star."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # Written first: a join that ends an aggregate would not be split at a hot hub.
    least = stored(least.select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "stars")
    return pairs.join(least, pairs["u"] == least["c"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _stars(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    stars = _stars(down)
    ends = stars.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return ends


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; root is the least node.

    Large-star and small-star steps alternate until the table stays the same:
    then it is one star per component. Edges with a null end, loops and
    repeated edges add nothing; an empty table gives an empty result; other
    columns are ignored. Only counts reach the driver; each step
    is written, so a lost executor costs a re-read.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    seen = None
    while True:
        edges = stored(_small(_large(edges).distinct()).where("a < b").distinct(), "edges")
        # Equal tables have equal sums; a step that changes an edge lowers one of its ends.
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select("a").distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.select("a", "a"))
