"""Positive and negative articles for explicit triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.hashing import hash_int, hash_key
from kinfold.operators.articles import value_counts
from kinfold.operators.ordering import lookup_join, sorted_position


def _neighbours(df: DataFrame, id_col: str, cate_col: str, order_col: str, tag: str) -> DataFrame:
    """Each row with its neighbours in (category, order); null at category ends.

    A window per category would put a large category into one task. Positions
    in one global order turn the neighbour into an equi-join on a unique key.
    """
    narrow = df.filter(F.col(cate_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(cate_col).alias("_cate"), F.col(order_col).alias("_order")
    )
    return sorted_position(narrow, [F.col("_cate"), F.col("_order"), F.col("_id")], "_pos", tag)


def next_positive(df: DataFrame, id_col: str, cate_col: str, order_col: str) -> DataFrame:
    """``(id, category, <id>_pos)``: the next article of the same category."""
    placed = _neighbours(df, id_col, cate_col, order_col, "next")
    after = placed.select(
        (F.col("_pos") - 1).alias("_pos"), F.col("_id").alias("_next"), F.col("_cate").alias("_next_cate")
    )
    nxt = F.when(F.col("_next_cate") == F.col("_cate"), F.col("_next"))
    return placed.join(after, "_pos", "left").select(
        F.col("_id").alias(id_col), F.col("_cate").alias(cate_col), nxt.alias(f"{id_col}_pos")
    )


def nearest_positive(df: DataFrame, id_col: str, cate_col: str) -> DataFrame:
    """``(id, category, <id>_pos)``: same-category article with the nearest id.

    The nearest is one of the two neighbours in id order; a tie takes the lower.
    """
    placed = _neighbours(df, id_col, cate_col, id_col, "nearest")
    side = placed.select("_pos", F.col("_id").alias("_other"), F.col("_cate").alias("_other_cate"))
    below = side.select((F.col("_pos") + 1).alias("_pos"), F.struct("_other", "_other_cate").alias("_below"))
    above = side.select((F.col("_pos") - 1).alias("_pos"), F.struct("_other", "_other_cate").alias("_above"))
    lo = F.when(F.col("_below._other_cate") == F.col("_cate"), F.col("_below._other"))
    hi = F.when(F.col("_above._other_cate") == F.col("_cate"), F.col("_above._other"))
    nearest = (
        F.when(hi.isNull(), lo)
        .when(lo.isNull(), hi)
        .when(F.col("_id") - lo <= hi - F.col("_id"), lo)
        .otherwise(hi)
    )
    return (
        placed.join(below, "_pos", "left")
        .join(above, "_pos", "left")
        .select(F.col("_id").alias(id_col), F.col("_cate").alias(cate_col), nearest.alias(f"{id_col}_pos"))
    )


def category_bounds(df: DataFrame, cate_col: str, min_cate: int = 2, max_cate: int | None = None) -> DataFrame:
    """Categories with an accepted number of articles."""
    sized = value_counts(df, cate_col).filter(F.col("n") >= min_cate)
    return sized if max_cate is None else sized.filter(F.col("n") <= max_cate)


def ring_negative(
    df: DataFrame, id_col: str, cate_col: str, min_cate: int = 2, max_cate: int | None = None, seed=42
) -> DataFrame:
    """``(id, category, <id>_neg)``: distinct other-category articles per category.

    All rows stand on a ring ordered by (category, seeded shuffle). The i-th
    row of a category takes the article i places (plus a seeded start) behind
    the end of its own block, so within one category no article repeats and
    none is of that category.
    """
    # Rows without a category anchor nothing but may serve as negatives.
    narrow = df.select(
        F.col(id_col).alias("_id"),
        F.col(cate_col).alias("_cate"),
        hash_key(seed, F.col(id_col)).alias("_key"),
    )
    placed = sorted_position(narrow, [F.col("_cate"), F.col("_key"), F.col("_id")], "_pos", "ring")
    blocks = placed.groupBy("_cate").agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    total = placed.count()
    accepted = F.col("_n") >= min_cate
    if max_cate is not None:
        accepted = accepted & (F.col("_n") <= max_cate)
    blocks = blocks.filter(accepted)
    short = blocks.filter(F.lit(total) - F.col("_n") < F.col("_n") - 1)
    if not short.isEmpty():
        raise ValueError("a category has fewer articles outside it than anchors inside it")
    others = F.lit(total) - F.col("_n")
    start = F.pmod(hash_int(seed, F.col("_cate")), others)
    target = F.pmod(
        F.col("_start") + F.col("_n") + F.pmod(start + F.col("_pos") - F.col("_start"), others), F.lit(total)
    )
    anchors = lookup_join(placed.select("_id", "_cate", "_pos"), blocks, "_cate", "inner", salt_on="_id")
    anchors = anchors.select("_id", "_cate", target.alias("_target"))
    return anchors.join(
        placed.select(F.col("_pos").alias("_target"), F.col("_id").alias("_neg")), "_target"
    ).select(F.col("_id").alias(id_col), F.col("_cate").alias(cate_col), F.col("_neg").alias(f"{id_col}_neg"))


def valid_triplet(df: DataFrame, pos_col: str, neg_col: str, out: str = "valid_triplet_data") -> DataFrame:
    both = F.col(pos_col).isNotNull() & F.col(neg_col).isNotNull()
    return df.withColumn(out, F.when(both, 1).otherwise(0).cast("int"))


def mine_triplets(
    df: DataFrame,
    id_col: str,
    cate_col: str,
    order_col: str,
    min_cate: int = 2,
    max_cate: int | None = None,
    seed=42,
) -> DataFrame:
    """The input with ``<id>_pos``, ``<id>_neg`` and ``valid_triplet_data``.

    Null means none. The last article of a category and articles of rejected
    categories have neither.
    """
    pos_col, neg_col = f"{id_col}_pos", f"{id_col}_neg"
    pos = next_positive(df, id_col, cate_col, order_col).drop(cate_col).filter(F.col(pos_col).isNotNull())
    neg = ring_negative(df, id_col, cate_col, min_cate, max_cate, seed).drop(cate_col)
    links = pos.join(neg, id_col, "inner")
    return valid_triplet(df.join(links, id_col, "left"), pos_col, neg_col)


def gather_triplet_content(mined: DataFrame, id_col: str, content: str, source: DataFrame | None = None) -> DataFrame:
    """Valid anchors with the content of their positive and negative article."""
    pos_col, neg_col = f"{id_col}_pos", f"{id_col}_neg"
    source = mined if source is None else source
    anchors = mined.filter(F.col("valid_triplet_data") == 1).select(id_col, content, pos_col, neg_col)
    pos = source.select(F.col(id_col).alias(pos_col), F.col(content).alias(f"{content}_pos"))
    neg = source.select(F.col(id_col).alias(neg_col), F.col(content).alias(f"{content}_neg"))
    return anchors.join(pos, pos_col).join(neg, neg_col)
