"""Exact duplicates by a tree merge of sorted digest runs.

Rows are dealt into runs by a hash of their id. A run holds one entry per
digest, sorted by digest: the smallest id and the number of rows. Runs are
merged in rounds along a binomial tree (with ``fan_in`` children a node instead
of two): in the round of stride s, run r takes the runs r + s, r + 2s and so on.
Each partition of a round receives the entries of one digest range of those
runs, merges them in digest order, and keeps one entry of neighbours that are
equal, until one run is left. A text with a third of all rows is an entry of a
few dozen bytes in each run from the first level on, and at most ``fan_in`` of
its entries meet in a later merge.

An entry is known by the SHA-256 of its normalised text; the text's length and
an independent 64-bit hash travel with it and are part of the comparison at
every level, so a merge is verified without moving texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import SPACES, materialize, remaining, row_key, stored, table, text_of

RUNS = 4096
FAN_IN = 16
DIGEST = ("sha", "length", "check")


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_of(name), SPACES, " ")


def digest_columns(name: str = "text") -> list[Column]:
    text = normalised(name)
    return [
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.length(text).cast("long").alias("length"),
        F.xxhash64(text).alias("check"),
    ]


def _merged(entries: DataFrame) -> DataFrame:
    """Merge the entries of each run that are neighbours in digest order."""
    order = [*DIGEST, F.col("keep_id").asc_nulls_last(), "keep_row"]
    met = entries.repartition("run", "sha").sortWithinPartitions("run", *order)
    equal = Window.partitionBy("run", *DIGEST).orderBy(*order[3:])
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.withColumn("place", F.row_number().over(equal)).withColumn("n", F.sum("group_size").over(whole))
    return met.where("place = 1").select("run", *DIGEST, "keep_id", "keep_row", F.col("n").alias("group_size"))


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Merge ``(row, doc_id, *DIGEST)`` to one ``(keep_id, keep_row, group_size)`` per digest.

    Ids that are null come after all others. keep_row is the row that stays.
    """
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "row"), F.lit(runs)))
    # Runs are made by partial aggregates, so that a task sends a text at most once a run.
    merged = dealt.groupBy("run", *DIGEST).agg(
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        F.count(F.lit(1)).alias("group_size"),
    )
    stride = 1
    while stride < runs:
        stride *= fan_in
        merged = _merged(merged.withColumn("run", F.col("run") - F.col("run") % stride))
    return merged.drop("run")


def _digests(docs: DataFrame, *more: Column) -> DataFrame:
    """``(row, doc_id, *DIGEST)`` and more columns, stored, so that row numbers stay."""
    rows = docs.select("doc_id", *digest_columns(), *more)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts of ``docs(doc_id, text)``, a row per input row.

    Returns doc_id, keep_id, group_size, kept and text_sha256. Null and empty
    texts are one text. The smallest id of a group stays; null ids come last,
    so a group of null ids alone has a null keep_id. Of rows that repeat both
    id and text one is kept, however often they stand there. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = _digests(docs)
    # Written first, so that the join is split at a text with many rows.
    groups = stored(merge_runs(rows).where("group_size > 1"), "digest-groups")
    named = groups.select("keep_id", "keep_row", "group_size", *[F.col(c).alias(f"of_{c}") for c in DIGEST])
    same = F.col("sha") == F.col("of_sha")
    for c in DIGEST[1:]:
        same = same & (F.col(c) == F.col(f"of_{c}"))
    joined = rows.join(named, same, "left")
    alone = F.col("of_sha").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    One row of each group of ``exact_groups`` stays: that of the smallest id,
    null ids last, and one of those that repeat it. An empty table stays empty;
    columns may have any names.
    """
    rows = _digests(docs, row_key()[1])
    kept = stored(merge_runs(rows).select("keep_row"), "digest-groups")
    stays = rows.join(kept, F.col("row") == F.col("keep_row"), "left_semi")
    return remaining(docs, rows.select("doc_id", "text_hash"), stays)


def op2_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
