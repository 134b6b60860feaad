"""Tables, numeric matrices and series in csv, tsv and parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.blocks import tasks_of
from kinfold.session import materialize, ship

SEPARATORS = {"csv": ",", "tsv": "\t"}  # fixed values

_FILL_ROWS = 256
_PARTS_PER_CORE = 4  # of a matrix that is filled up
_ZERO = "0.0"

# Quotes are doubled inside quoted fields; blanks and empty strings survive.
_QUOTING = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# On reading, an unquoted empty field is null and a quoted one an empty string.
_READING = {**_QUOTING, "nullValue": "\u0000", "emptyValue": ""}


def file_format(path: str, fmt: str | None = None, allowed: tuple[str, ...] = ("csv", "tsv", "parquet")) -> str:
    """The format named, else the lower-cased suffix of the path."""
    fmt = (fmt or str(path).lower().rsplit(".", 1)[-1]).lower()
    if fmt not in allowed:
        raise ValueError(f"format should be one of {', '.join(allowed)}; got {fmt!r}")
    return fmt


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    key: str | None = None,
    multi_line: bool = False,
    **options,
) -> DataFrame:
    """A table whose first column (or ``key``) is its key; a missing path raises.

    Without a schema, csv and tsv types (timestamps included) are inferred by
    an extra pass over the file. ``multi_line`` is for texts with line breaks:
    such a file cannot be split, and one task reads it.
    """
    fmt = file_format(path, fmt)
    if fmt == "parquet":
        df = spark.read.options(**options).parquet(path)
    else:
        text = {"sep": SEPARATORS[fmt], "header": "true", "multiLine": multi_line, **_READING, **options}
        reader = spark.read.options(**text)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
        df = reader.csv(path)
    if key and key not in df.columns:
        raise ValueError(f"key column {key!r} is not in {path}")
    return df


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists", **options) -> None:
    fmt = file_format(path, fmt)
    if fmt == "parquet":
        df.write.mode(mode).options(**options).parquet(path)
        return
    text = {"sep": SEPARATORS[fmt], "header": "true", "emptyValue": '""', **_QUOTING, **options}
    exploded = [
        F.concat_ws(" ", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*exploded).write.mode(mode).options(**text).csv(path)


def read_series(
    spark: SparkSession, path: str, schema: str, fmt: str | None = None, multi_line: bool = False
) -> DataFrame:
    """A headerless two-column key/value file; ``schema`` such as 'key bigint, value string'."""
    fmt = file_format(path, fmt, ("csv", "tsv"))
    text = {"sep": SEPARATORS[fmt], "header": "false", "multiLine": multi_line, **_READING}
    return spark.read.schema(schema).options(**text).csv(path)


def write_series(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    fmt = file_format(path, fmt, ("csv", "tsv"))
    df.write.mode(mode).options(sep=SEPARATORS[fmt], header="false", emptyValue='""', **_QUOTING).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(row, value)``: physical lines with their 0-based number.

    Files follow each other by path. Lines stay in the split they are read in,
    whose first number comes from the counts of the splits before it.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    lines = materialize(lines, "lines")  # freezes the layout that the ids depend on
    sizes = lines.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per split, so one window and a broadcast are enough.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = lines.join(F.broadcast(splits), ["_file", "_block"])
    return placed.select((F.col("_offset") + F.col("_line") - F.col("_first")).alias("row"), "value")


def read_matrix(spark: SparkSession, path: str, fmt: str | None = None, sparse: bool = False) -> DataFrame:
    """A headerless numeric file: ``(row, vec)``, or ``(row, term_id, value)`` without zeros."""
    fmt = file_format(path, fmt, ("csv", "tsv"))
    lines = numbered_lines(spark, path).filter(F.length("value") > 0)
    cells = F.split("value", SEPARATORS[fmt])
    if not sparse:
        return lines.select("row", cells.cast("array<double>").alias("vec"))
    # Most cells are plain zeros, which need no parsing.
    found = lines.select("row", F.posexplode(cells).alias("term_id", "value")).filter(F.col("value") != _ZERO)
    return found.withColumn("value", F.col("value").cast("double")).filter(F.col("value") != 0.0)


def _filled(packed: DataFrame, n_features: int, separator: str) -> DataFrame:
    """A line per packed row, with explicit zeros; ``val`` holds the cells as they are written."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, _FILL_ROWS):
                part, lines = batch.slice(s, _FILL_ROWS), []
                for idx, val in zip(part.column("idx").to_pylist(), part.column("val").to_pylist()):
                    cells = [_ZERO] * n_features
                    for i, cell in zip(idx or (), val or ()):
                        if i is not None and 0 <= i < n_features:
                            cells[i] = cell
                    lines.append(separator.join(cells))
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    ship(packed.sparkSession)
    return packed.select("idx", "val").mapInArrow(fill, "value string")


def write_matrix(
    df: DataFrame,
    path: str,
    order: str,
    fmt: str | None = None,
    n_features: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Rows ``vec`` (or packed ``idx``/``val``, written with their zeros) in ``order``.

    Files are range-sorted, so that their names follow the order. Packed rows are
    sorted as they are, into a number of parts that their bytes do not lower, and
    filled up where they are written, some rows at a time; these lines, which are
    zeros for the most part, are compressed.
    """
    fmt = file_format(path, fmt, ("csv", "tsv"))
    spark, separator = df.sparkSession, SEPARATORS[fmt]
    cell = lambda x: x.cast("double").cast("string")
    options = {}
    if "vec" in df.columns:
        line = F.concat_ws(separator, F.transform("vec", cell))
        ordered = df.select(F.col(order).alias("_order"), line.alias("value"))
        lines = ordered.repartitionByRange("_order").sortWithinPartitions("_order").select("value")
    else:
        if n_features is None:
            raise ValueError("a packed matrix needs n_features")
        cells = F.transform("val", lambda x: F.coalesce(cell(x), F.lit("NaN")))
        parts = max(tasks_of(spark), _PARTS_PER_CORE * spark.sparkContext.defaultParallelism)
        ordered = df.select(F.col(order).alias("_order"), "idx", cells.alias("val"))
        lines = _filled(ordered.repartitionByRange(parts, "_order").sortWithinPartitions("_order"), n_features, separator)
        options["compression"] = "gzip"
    lines.write.mode(mode).options(**options).text(path)
