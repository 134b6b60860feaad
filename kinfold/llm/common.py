"""What the corpus operators share: tables, row identity, text normalisation."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import materialize, ship

# White space of the contracts: space and the control characters 9 to 13.
SPACES = "[\\x20\\x09-\\x0D]+"
WORDS = "[^\\x20\\x09-\\x0D]+"

BITMAP = 1 << 15  # bits of one value of Spark's bitmap functions
SIEVE = 1 << 31


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one column ``row``, so that no column of it clashes with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def stored(df: DataFrame, tag: str, waves: int = 4) -> DataFrame:
    """Write a slim table that a shuffle has made, in at most ``waves`` files per core, and read it again.

    A shuffle's partitions are counted for the tables of texts; for what is
    left of a row here (digests, edges, counts) that many files are too small.
    """
    return materialize(df.coalesce(max(1, waves * df.sparkSession.sparkContext.defaultParallelism)), tag)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What a row is known by: its id and a hash of its whole text."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash")]


def remaining(docs: DataFrame, keys: DataFrame, stays: DataFrame, most: int = SIEVE) -> DataFrame:
    """The rows of ``docs`` whose key stands in ``stays``, one row per key, with all their columns.

    ``keys`` and ``stays`` hold ``(doc_id, text_hash)`` of ``row_key``: every
    row's, and once each that stays. Texts are not moved: the keys that go, or
    stand there several times, set bits of a sieve of 16 bits a key and at most
    ``most`` bits (256 MB), which goes to the tasks. A row whose bit is not set
    passes where it is read; only the others are shuffled and judged by their
    key, so a sieve too small for its keys costs time, never rows. Null ids are
    equal, null texts count as empty, columns may have any names, and an empty
    table stays empty.
    """
    counted = keys.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    named = stays.select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash"))
    marked = counted.join(named, same, "left").where("stay_hash is null or n > 1")
    marked = stored(
        marked.select(
            F.col("doc_id").alias("gone_id"),
            F.col("text_hash").alias("gone_hash"),
            F.col("stay_hash").isNull().alias("goes"),
            (F.col("n") > 1).alias("repeated"),
        ),
        "gone",
    )
    n, n_repeated = marked.agg(F.count(F.lit(1)), F.count_if("repeated")).first()
    bits = min(most, max(BITMAP, 1 << (16 * n).bit_length()))

    def place(doc_id: str, text_hash: str) -> list[Column]:
        slot = F.pmod(F.xxhash64(doc_id, text_hash), F.lit(bits))
        return [F.floor(slot / BITMAP), (slot % BITMAP).cast("int")]

    def is_set(bitmap: str) -> Column:
        byte = F.conv(F.hex(F.substring(bitmap, F.floor(F.col("own_at") / 8).cast("int") + 1, F.lit(1))), 16, 10)
        return F.coalesce(F.getbit(byte.cast("int"), F.col("own_at") % 8) == 1, F.lit(False))

    part, at = place("gone_id", "gone_hash")
    sieve = marked.select(part.alias("part"), at.alias("at"), "repeated").groupBy("part")
    sieve = sieve.agg(
        F.bitmap_construct_agg("at").alias("met"), F.bitmap_construct_agg(F.when(F.col("repeated"), F.col("at"))).alias("many")
    )
    rows = whole_rows(docs).select("row", F.struct(*row_key("row.doc_id", "row.text")).alias("key"))
    part, at = place("key.doc_id", "key.text_hash")
    sifted = rows.withColumns({"own_part": part, "own_at": at})
    sifted = sifted.join(F.broadcast(sieve), F.col("own_part") == F.col("part"), "left")
    sifted = sifted.select("row", "key.*", is_set("met").alias("met"), is_set("many").alias("many"))
    gone = marked.where("goes")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    found = sifted.where("not met").select("row")
    found = found.union(sifted.where("met and not many").join(gone, same, "left_anti").select("row"))
    if n_repeated:
        # One row of each key leaves a task, so that a row that stands very often never meets itself.
        once = sifted.where("met and many").dropDuplicates(["doc_id", "text_hash"])
        found = found.union(once.join(gone, same, "left_anti").select("row"))
    return unpacked(found, docs.columns)


def new_name(df: DataFrame, *names: str) -> None:
    """Refuse to add a column under a name that is there already, in whatever case."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"the table has columns named {sorted(clash)}; choose other names for the result")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_training(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels a model may learn from; the others are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> dict[int, list[str]]:
    """At most ``per_class`` whole training texts of each class.

    Texts are picked in the order of a hash of their id, so the sample does not
    depend on the layout of the tables. Only texts of 1 to ``chars`` characters
    are candidates, which bounds what reaches the driver. Null labels and ids
    with contradicting labels are left out.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & in_training(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    # Ids are picked first, so that no texts but those taken are moved.
    fit = docs.where(F.length("text").between(1, chars)).select("doc_id").join(known, "doc_id")
    picked: dict[int, list[str]] = {}
    for value in (0, 1):
        order = F.xxhash64("doc_id")
        ids = fit.where(F.col("label") == value).select("doc_id").distinct().orderBy(order, "doc_id").limit(per_class)
        texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text").between(1, chars))
        rows = texts.orderBy("doc_id", "text").limit(per_class).collect()
        picked[value] = [r["text"] for r in sorted(rows, key=lambda r: xxhash.xxh64_intdigest(r["text"].encode()))]
    return picked


def label_share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among the training labels; one half if there are none."""
    known = labels.where(F.col(label).cast("int").isin(0, 1) & in_training(F.col("doc_id")))
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return 0.5 if share is None else float(share)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Coefficients of a ridge logistic regression, the intercept last, by damped Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    keep = np.full(x.shape[1], ridge * weight.sum() / 100)
    keep[-1] = 1e-6

    def loss(b: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, -(2 * y - 1) * (x @ b)) + (keep * b * b).sum() / 2)

    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(steps):
        p = logistic(x @ b)
        slope = x.T @ (weight * (p - y)) + keep * b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step, rate = np.linalg.solve(curve, slope), 1.0
        while rate > 1e-6 and loss(b - rate * step) > now:
            rate /= 2
        b = b - rate * step
        before, now = now, loss(b)
        if before - now < 1e-9 * max(1.0, before):
            break
    return b


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


__all__ = [
    "SPACES",
    "WORDS",
    "fit_logistic",
    "in_training",
    "label_share",
    "labelled_sample",
    "logistic",
    "materialize",
    "new_name",
    "remaining",
    "row_key",
    "ship",
    "stored",
    "table",
    "text_of",
    "unpacked",
    "whole_rows",
]
