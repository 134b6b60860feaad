"""Input corruption on packed rows; every operator stays inside its row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.hashing import hash_uniform
from kinfold.operators.vectorize import matrix_extremes
from kinfold.session import ship

CORRUPTIONS = ("none", "masking", "salt_and_pepper", "decay")
_DRAWS = 1 << 18  # draws that a task holds at once
_NO_INDEX = -(1 << 31)  # stands for a null index


def _packed(df: DataFrame, entries) -> DataFrame:
    rows = df.withColumn("_e", entries)
    return rows.withColumn("idx", F.col("_e.i")).withColumn("val", F.col("_e.v")).drop("_e")


def _entries():
    return F.zip_with("idx", "val", lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")))


def masking_noise(
    packed: DataFrame, v: float, id_col: str, seed=42, epoch: int = 0, method: str = "md5"
) -> DataFrame:
    """Keep each stored value with probability ``1 - v``."""
    if not 0.0 <= v <= 1.0:
        raise ValueError("the corruption rate must be in [0, 1]")
    draw = lambda e: hash_uniform(f"{seed}:{epoch}", F.col(id_col), e["i"], method=method)
    return _packed(packed, F.filter(_entries(), lambda e: draw(e) >= v))


def salt_pepper_noise(
    packed: DataFrame,
    draws: int,
    n_features: int,
    id_col: str,
    seed=42,
    epoch: int = 0,
    extremes: tuple[float, float] | None = None,
) -> DataFrame:
    """Set ``draws`` random positions per row to the global minimum or maximum.

    Positions are drawn with replacement and the last draw of a position wins.
    Old and drawn entries are sorted by (position, draw) inside the row, and the
    last of each position is kept; zeros are not stored.
    """
    if extremes is None:
        found = matrix_extremes(packed, n_features).first()
        extremes = (found["min_value"], found["max_value"])
    ship(packed.sparkSession)
    names = packed.columns
    kinds = {"idx": T.ArrayType(T.IntegerType()), "val": T.ArrayType(T.DoubleType())}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in packed.schema.fields])
    key = F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col(id_col).cast("string"))
    entries = F.zip_with("idx", "val", lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")))
    rows = packed.withColumn("_e", entries).withColumn("idx", F.col("_e.i")).withColumn("val", F.col("_e.v"))
    rows = rows.drop("_e").withColumn("_key", key)
    draws = max(draws, 0)
    low, high = map(float, extremes) if draws else (0.0, 0.0)
    step = max(1, _DRAWS // max(draws, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [f":{n}".encode() for n in range(1, draws + 1)]
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                made = dict(zip(("idx", "val"), _salted(part, numbers, n_features, low, high)))
                yield pa.RecordBatch.from_arrays([made.get(n, part.column(n)) for n in names], names=names)

    return rows.mapInArrow(run, schema)


def _salted(rows: pa.RecordBatch, numbers: list[bytes], n_features: int, low: float, high: float) -> tuple[pa.Array, pa.Array]:
    """Indices and values of some rows after the draws named by ``_key`` and a number, as the digests of ``hash_key`` say."""
    idx, val = rows.column("idx"), rows.column("val")
    n, none = len(idx), idx.is_null().to_numpy(zero_copy_only=False)
    old_i = idx.flatten().fill_null(_NO_INDEX).to_numpy().astype(np.int64)
    old_v, known = val.flatten().fill_null(0.0).to_numpy(), val.flatten().is_valid().to_numpy(zero_copy_only=False)
    old_row = np.repeat(np.arange(n), np.nan_to_num(idx.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    order = np.lexsort((old_v, known, old_i, old_row))
    i, v, row = old_i[order], old_v[order], old_row[order]
    if numbers:
        keys = [k.encode() for k in rows.column("_key").to_pylist()]
        digests = b"".join([hashlib.md5(k + number).digest() for k in keys for number in numbers])
        words = np.frombuffer(digests, ">u4").reshape(-1, 4)
        i = np.concatenate([i, words[:, 0].astype(np.int64) % n_features])
        v = np.concatenate([v, np.where(words[:, 1] % 2 == 0, low, high)])
        row = np.concatenate([row, np.repeat(np.arange(n), len(numbers))])
    # Stable, and old entries come before the draws: the last of a position is the one that stays.
    place = (row << 33) + (i - _NO_INDEX)
    order = place.argsort(kind="stable")
    i, v, row, place = i[order], v[order], row[order], place[order]
    last = np.append(place[1:] != place[:-1], True) if len(place) else np.zeros(0, bool)
    last &= (v != 0) & ~none[row]
    i, v, row = i[last], v[last], row[last]
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    mask = pa.array(none)
    index = pa.array(i.astype(np.int32), mask=i == _NO_INDEX)
    return pa.ListArray.from_arrays(ends, index, mask=mask), pa.ListArray.from_arrays(ends, pa.array(v), mask=mask)


def decay_noise(packed: DataFrame, v: float) -> DataFrame:
    """Scale every value by ``1 - v``."""
    return packed.withColumn("val", F.transform("val", lambda x: x.cast("double") * F.lit(1.0 - v)))


def corrupt(
    packed: DataFrame,
    corr_type: str,
    corr_frac: float,
    n_features: int,
    id_col: str,
    seed=42,
    epoch: int = 0,
    method: str = "md5",
    extremes: tuple[float, float] | None = None,
) -> DataFrame:
    """Apply the named corruption; the number of salt-and-pepper draws is rounded half to even."""
    if corr_type == "none":
        return packed
    if corr_type == "masking":
        return masking_noise(packed, corr_frac, id_col, seed, epoch, method)
    if corr_type == "salt_and_pepper":
        draws = round(corr_frac * n_features)
        return salt_pepper_noise(packed, draws, n_features, id_col, seed, epoch, extremes)
    if corr_type == "decay":
        return decay_noise(packed, corr_frac)
    raise ValueError(f"corr_type must be one of {CORRUPTIONS}; got {corr_type!r}")
