"""Reconstruction and triplet losses over rows of dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import EPS, as_double, dot, l2_normalize, safe_log, softplus

LOSSES = ("cross_entropy", "mean_squared", "cosine_proximity")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def reconstruction_loss(x: Column, decode: Column, loss_func: str = "cross_entropy") -> Column:
    """Loss of one row against its reconstruction."""
    x, d = as_double(x), as_double(decode)
    if loss_func == "cross_entropy":
        return -_total(F.zip_with(x, d, lambda a, b: a * safe_log(b) + (1.0 - a) * safe_log(1.0 - b)))
    if loss_func == "mean_squared":
        return _total(F.zip_with(x, d, lambda a, b: (a - b) * (a - b)))
    if loss_func == "cosine_proximity":
        return -dot(l2_normalize(x), l2_normalize(d))
    raise ValueError(f"loss_func must be one of {LOSSES}; got {loss_func!r}")


def _weighted_mean(loss: Column, weight: Column) -> Column:
    return F.sum(loss * weight) / (F.sum(weight) + F.lit(EPS))


def weighted_loss(
    df: DataFrame,
    loss_func: str = "cross_entropy",
    x: str = "x",
    decode: str = "decode",
    weight_col: str | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """``(by..., loss)``: weighted mean of the row losses; the weight defaults to 1."""
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = df.select(
        *(by or []), reconstruction_loss(F.col(x), F.col(decode), loss_func).alias("_l"), weight.alias("_w")
    )
    return rows.groupBy(*(by or [])).agg(_weighted_mean(F.col("_l"), F.col("_w")).alias("loss"))


def explicit_triplet_loss(
    df: DataFrame, loss_func: str = "cross_entropy", alpha: float = 1.0, by: list[str] | None = None
) -> DataFrame:
    """``(by..., autoencoder_loss, triplet_loss, cost)`` for rows with
    ``x, decode, encode`` and their ``_pos`` and ``_neg`` counterparts."""
    parts = [
        reconstruction_loss(F.col(f"x{s}"), F.col(f"decode{s}"), loss_func).alias(f"_l{s or '_org'}")
        for s in ("", "_pos", "_neg")
    ]
    gap = dot(F.col("encode"), F.col("encode_pos")) - dot(F.col("encode"), F.col("encode_neg"))
    rows = df.select(*(by or []), *parts, softplus(-gap).alias("_t"))
    one = F.lit(1.0)
    ae = sum((_weighted_mean(F.col(c), one) for c in ("_l_org", "_l_pos", "_l_neg")), F.lit(0.0))
    out = rows.groupBy(*(by or [])).agg(ae.alias("autoencoder_loss"), F.avg("_t").alias("triplet_loss"))
    return out.withColumn("cost", F.col("autoencoder_loss") + F.lit(alpha) * F.col("triplet_loss"))


def overall_cost(
    rows: DataFrame,
    triplet_stats: DataFrame | None,
    weights: DataFrame | None,
    loss_func: str = "cross_entropy",
    alpha: float = 1.0,
) -> DataFrame:
    """``(batch_id, autoencoder_loss, triplet_loss, cost)``.

    ``weights`` gives each row its number of triplets; without triplets the
    cost is the unweighted reconstruction loss.
    """
    if triplet_stats is None:
        ae = weighted_loss(rows, loss_func, by=["batch_id"])
        return ae.select("batch_id", F.col("loss").alias("autoencoder_loss"), F.col("loss").alias("cost"))
    weighted = rows.join(weights, ["batch_id", "id"])
    ae = weighted_loss(weighted, loss_func, weight_col="weight", by=["batch_id"])
    joined = ae.withColumnRenamed("loss", "autoencoder_loss").join(
        triplet_stats.select("batch_id", F.col("loss").alias("triplet_loss")), "batch_id"
    )
    return joined.withColumn("cost", F.col("autoencoder_loss") + F.lit(alpha) * F.col("triplet_loss"))
