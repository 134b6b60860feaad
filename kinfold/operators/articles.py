"""Article table: cleaning, stories, labels, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.functions.hashing import hash_key
from kinfold.functions.permutation import permuted
from kinfold.operators.ordering import (
    lookup_join,
    numbered,
    rank_distinct,
    sorted_position,
)
from kinfold.session import materialize


def clean(df: DataFrame, content: str = "main_content") -> DataFrame:
    """Drop rows whose content is null or blank; also runs on streams."""
    return df.filter(F.col(content).isNotNull() & ~T.is_blank(F.col(content)))


def with_story(df: DataFrame, title: str = "title", story: str = "story") -> DataFrame:
    """Add the story found in the title, unless the column is there already."""
    if story in df.columns:
        return df
    return df.withColumn(story, T.story_of_title(F.col(title)))


def with_plain_category(df: DataFrame, category: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or category, T.strip_leading_chars(F.col(category)))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Rows per non-null value."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def label_valid(
    df: DataFrame,
    value: str,
    out: str,
    min_count: int = 1,
    max_count: int | None = None,
    deny: tuple[str, ...] = (),
) -> DataFrame:
    """1 where the value is non-null, frequent enough and not denied, else 0."""
    allowed = F.col(value).isNotNull()
    if deny:
        allowed = allowed & ~F.col(value).isin(list(deny))
    if min_count <= 1 and max_count is None:
        return df.withColumn(out, F.when(allowed, 1).otherwise(0).cast("int"))
    in_bounds = F.col("n") >= min_count
    if max_count is not None:
        in_bounds = in_bounds & (F.col("n") <= max_count)
    keep = value_counts(df, value).filter(in_bounds).select(value, F.lit(True).alias("_ok"))
    flagged = lookup_join(df, keep, value, "left")
    return flagged.withColumn(
        out, F.when(allowed & F.col("_ok").isNotNull(), 1).otherwise(0).cast("int")
    ).drop("_ok")


def factorize(
    df: DataFrame, value: str, order: str, out: str, descending: bool = False, salt_on: str | None = None
) -> DataFrame:
    """Integer codes by order of first appearance; null becomes -1."""
    first = F.max(order) if descending else F.min(order)
    seen = df.filter(F.col(value).isNotNull()).groupBy(value).agg(first.alias("_first"))
    seen = materialize(seen, "distinct")
    by = F.col("_first").desc() if descending else F.col("_first").asc()
    codes = rank_distinct(seen, [by, F.col(value)], "_code", "factorize").select(value, "_code")
    joined = lookup_join(df, codes, value, "left", salt_on=salt_on, stored=True)
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_code")


def eligible(df: DataFrame, valid: str, triplet_strategy: str = "batch_all") -> DataFrame:
    """Rows with a valid label; everything when no triplets are trained."""
    return df if triplet_strategy == "none" else df.filter(F.col(valid) == 1)


def _cut_by_position(df: DataFrame, order: str, tie: str | None, spans: list[tuple[str, int, int]], out: str) -> DataFrame:
    """Name the rows whose position lies in a span ``(name, start, stop)``; drop the others.

    Only the order and the tie-break are sorted. The rows at the ends of the
    spans then cut the wide table by comparison, so it is neither sorted nor
    shuffled. Rows that share both values at a cut cannot be told apart and
    raise an error. Null values come first.
    """
    keys = [order] if tie is None or tie == order else [order, tie]
    ranked = sorted_position(df.select(*keys), [F.col(k).asc_nulls_first() for k in keys], "_pos", "split")
    last = F.struct("_pos", *keys)
    spans = [x for x in spans if x[2] > x[1]]
    ends = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.when(F.col("_pos") < stop, last)).alias(f"stop{i}") for i, (_, _, stop) in enumerate(spans)],
        *[F.max(F.when(F.col("_pos") < start, last)).alias(f"start{i}") for i, (_, start, _) in enumerate(spans)],
    ).first()
    if not spans or not ends["n"]:
        return df.withColumn(out, F.lit(None).cast("string")).limit(0)

    def up_to(end) -> Column:
        """Whether a row is not after an end, null before all other values."""
        below, equal = F.lit(False), F.lit(True)
        for k in keys:
            value = F.lit(end[k])
            less = F.coalesce(F.col(k) < value, F.col(k).isNull() & value.isNotNull())
            below = below | (equal & less)
            equal = equal & F.col(k).eqNullSafe(value)
        return below | equal

    name = F.lit(None).cast("string")
    for i, (label, _, _) in reversed(list(enumerate(spans))):
        inside = up_to(ends[f"stop{i}"])
        if ends[f"start{i}"] is not None:
            inside = inside & ~up_to(ends[f"start{i}"])
        name = F.when(inside, F.lit(label)).otherwise(name)
    parts = df.withColumn(out, name).filter(F.col(out).isNotNull())
    got = dict(ranked.select(*keys).withColumn(out, name).groupBy(out).count().collect())
    for label, start, stop in spans:
        wanted = max(0, min(stop, ends["n"]) - start)
        if got.get(label, 0) != wanted:
            raise ValueError(f"rows with equal {' and '.join(keys)} at the cut of {label!r}; name a unique tie column")
    return parts


def latest_split(
    df: DataFrame, id_col: str, train_rows: int, validate_rows: int, out: str = "split", tie: str | None = None
) -> DataFrame:
    """Keep the latest rows by ``id_col``, ties by ``tie``; the lower ones train, the higher validate."""
    start = max(0, df.count() - train_rows - validate_rows)
    middle = start + train_rows
    spans = [("train", start, middle), ("validate", middle, middle + validate_rows)]
    return _cut_by_position(df, id_col, tie, spans, out)


def positional_split(
    df: DataFrame, order: str, train_rows: int, validate_rows: int, out: str = "split", tie: str | None = None
) -> DataFrame:
    """First rows by ``order``, ties by ``tie``, train, the next validate, the rest is dropped."""
    spans = [("train", 0, train_rows), ("validate", train_rows, train_rows + validate_rows)]
    return _cut_by_position(df, order, tie, spans, out)


def shuffle_positions(df: DataFrame, seed, out: str = "pos") -> DataFrame:
    """Each row with its place in a seeded shuffle of the rows as they are read; no row is moved."""
    rows = numbered(df, "_number", "shuffle")
    place = permuted(F.col("_number"), max(rows.count(), 1), seed)
    return rows.withColumn(out, place).drop("_number")


def shuffled(df: DataFrame, id_col: str, seed) -> DataFrame:
    """The whole table in seeded random order."""
    return df.orderBy(hash_key(seed, F.col(id_col)), F.col(id_col))


def append_splits(train: DataFrame, validate: DataFrame) -> DataFrame:
    return train.unionByName(validate)


def check_results(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(name, holds)`` of aggregate conditions, all from one pass; a condition without rows to judge holds."""
    row = df.agg(*[F.coalesce(cond, F.lit(True)).alias(f"_{i}") for i, cond in enumerate(checks.values())])
    results = [F.struct(F.lit(name).alias("name"), F.col(f"_{i}").alias("holds")) for i, name in enumerate(checks)]
    return row.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def require(df: DataFrame, checks: dict[str, Column]) -> None:
    """Evaluate all aggregate conditions in one pass; raise for the failed ones."""
    failed = [r["name"] for r in check_results(df, checks).where("NOT holds").collect()]
    if failed:
        raise ValueError("input check failed: " + "; ".join(failed))
