"""The given tables in their roles: documents as articles, embeddings as codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import vectorize as V
from kinfold.plans.sql import MAX_FEATURES, SEED
from kinfold.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a bracketed title, and their language as prefixed category."""
    title = F.concat(F.lit("【"), "source", F.lit("（"), "lang", F.lit("）】"), "text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("main_content"),
        title.alias("title"),
        F.concat(F.lit("即時"), "lang").alias("category_publish_name"),
        "source",
        "lang",
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return V.tokenized(docs, "doc_id", "text", stop_words="english")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dense rows with labels."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label")
    )


def scaled_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with lengths from 1 to 5, which the norms and kernels tell apart."""
    factor = (1 + F.col("vec_id") % 5).cast("double")
    return codes(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * factor))


def fitted(spark: SparkSession, sf_dir: str, k: int = MAX_FEATURES):
    """Per-article term counts (stored once), vocabulary and number of articles."""
    counted = materialize(V.counted(tokens(spark, sf_dir), "doc_id"), "terms")
    n_docs = counted.count()
    return counted, V.fit_vocab(counted, "doc_id", max_df=0.99, max_features=k, n_docs=n_docs), n_docs


def fitted_vectors(spark: SparkSession, sf_dir: str, k: int = MAX_FEATURES):
    """``(doc_id, idx, val, tfidf)`` for every document, stored once, with the vocabulary and number of articles."""
    counted, vocab, n_docs = fitted(spark, sf_dir, k)
    return materialize(V.vectorize(counted, vocab, "doc_id", n_docs), "vectors"), vocab, n_docs


def vectors(spark: SparkSession, sf_dir: str, k: int = MAX_FEATURES) -> DataFrame:
    """``(doc_id, idx, val, tfidf)`` for every document, stored once."""
    return fitted_vectors(spark, sf_dir, k)[0]


__all__ = ["SEED", "articles", "codes", "fitted", "fitted_vectors", "scaled_codes", "table", "tokens", "vectors"]
