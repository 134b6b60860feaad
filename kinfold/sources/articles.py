"""Article tables and the labelled-text exchange with an external embedding tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.text import LABEL_PREFIX
from kinfold.operators.articles import clean, with_story
from kinfold.session import materialize
from kinfold.sources.files import numbered_lines, write_matrix, write_table

REQUIRED = ("article_id", "title", "main_content")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Parquet articles with non-blank content and a story per title."""
    df = spark.read.parquet(path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"article table lacks {', '.join(missing)}")
    kind = df.schema["article_id"].dataType.typeName()
    if kind not in ("integer", "long", "short", "byte"):
        raise ValueError(f"article_id must be an integer column, got {kind}")
    return with_story(clean(df))


def save_articles(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def labelled_lines(terms: DataFrame, category: str) -> DataFrame:
    """``(id..., line)``: the terms of an article, then its label."""
    line = F.concat_ws(" ", F.col("terms"))
    return terms.withColumn("line", F.concat(line, F.lit(" " + LABEL_PREFIX), F.col(category)))


def write_labelled_text(terms: DataFrame, category: str, order: str, path: str) -> None:
    rows = labelled_lines(terms, category).select(F.col(order).alias("_order"), F.col("line").alias("value"))
    rows.repartitionByRange("_order").sortWithinPartitions("_order").select("value").write.text(path)


def trim_tool_output(lines: DataFrame) -> DataFrame:
    """Of numbered lines keep the 5th, 7th, 9th, ... (the embeddings), renumbered.

    The tool prints three header lines, then input and embedding in turn.
    """
    kept = lines.filter((F.col("row") >= 4) & (F.col("row") % 2 == 0))
    return kept.select(((F.col("row") - 4) / 2).cast("bigint").alias("row"), "value")


def parse_vector(line: Column) -> Column:
    """Space-separated numbers; a trailing blank adds nothing."""
    return F.filter(F.split(line, " "), lambda x: x != "").cast("array<double>")


def read_embeddings(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """``(row, vec)`` from a text file of vectors, or from the raw tool output."""
    lines = numbered_lines(spark, path)
    if raw:
        # Written first: what follows may look at the lines before the filter, and headers are no numbers.
        lines = materialize(trim_tool_output(lines), "trimmed")
    return lines.select("row", parse_vector(F.col("value")).alias("vec"))


def write_projector(vectors: DataFrame, articles: DataFrame, id_col: str, path: str) -> None:
    """Vectors and label columns as two tsv folders with rows in the same order."""
    columns = ["label_story", "label_category_publish_name", "title", "story", "category_publish_name"]
    write_matrix(vectors, f"{path}/vectors.tsv", id_col, "tsv")
    ordered = articles.select(id_col, *columns).repartitionByRange(id_col).sortWithinPartitions(id_col)
    meta = ordered.drop(id_col)
    write_table(meta, f"{path}/labels.tsv")
