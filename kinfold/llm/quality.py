"""Quality by compression against dictionaries of good and of bad texts.

A text is cut into blocks, and each block is compressed on its own with a
dictionary trained on good and one trained on bad labelled texts. The
difference of the two sizes, per byte of text, says which texts it is nearer
to. A logistic regression on that difference, with the two rates and the
length (short texts compress less, repetition compresses both ways), turns it
into a probability; it is fitted on labelled texts that are in no dictionary.

The model is trained on a bounded sample and weighs some 200 KB; scoring is a
map over all texts, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import (
    fit_logistic,
    in_training,
    label_share,
    labelled_sample,
    logistic,
    new_name,
    ship,
    table,
    text_of,
)

PER_CLASS = 2000  # texts of each class learned from, at most
SAMPLE_CHARS = 20_000  # longest text learned from
DICTIONARY = 112_640  # bytes of a dictionary
BLOCK = 2048  # bytes compressed at once
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration; without dictionaries a constant."""

    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float = 0.5


def _blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(texts: list[str]) -> bytes:
    blocks = [b for t in texts for b in _blocks(t)]
    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 4)), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return b"".join(blocks)[-DICTIONARY:]


class _Sizes:
    """Compressed sizes of texts under the dictionaries of a model."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for data in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, **bare))

    def features(self, text: str) -> tuple[float, float, float, float]:
        good = bad = length = 0
        for block in _blocks(text):
            good += len(self.compressors[0].compress(block))
            bad += len(self.compressors[1].compress(block))
            length += len(block)
        size = length + 32
        return (bad - good) / size, good / size, bad / size, math.log(size)


def _expanded(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return np.column_stack([x, *[x[:, i] * x[:, j] for i in range(n) for j in range(i + 1)]])


def train_quality(good: list[str], bad: list[str], share: float) -> QualityModel:
    """Half of each list becomes a dictionary, the other half calibrates; ``share`` of all texts are good."""
    if len(good) < 2 or len(bad) < 2:
        return QualityModel(b"", b"", (), (), (), share)
    sets = [texts[::2] for texts in (good, bad)]
    held = [texts[1::2] for texts in (good, bad)]
    dictionaries = [_dictionary(s) for s in sets]
    sizes = _Sizes(*dictionaries)
    x = np.array([sizes.features(t) for texts in held for t in texts])
    y = np.repeat([1.0, 0.0], [len(h) for h in held])
    prior = min(max(share, 0.01), 0.99)
    weight = np.where(y == 1, prior / len(held[0]), (1 - prior) / len(held[1])) * len(y)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = fit_logistic(_expanded((x - centre) / scale), y, weight, ridge=1e-2)
    return QualityModel(*dictionaries, tuple(centre), tuple(scale), tuple(weights), share)


def score_texts(model: QualityModel, texts: list[str], sizes: _Sizes) -> np.ndarray:
    x = np.array([sizes.features(t) for t in texts]).reshape(-1, 4)
    z = _expanded((x - np.array(model.centre)) / np.array(model.scale))
    # Summed row by row, so that a text's score does not depend on its batch.
    return logistic((z * np.array(model.weights[:-1])).sum(axis=1) + model.weights[-1])


def quality_score(model: QualityModel, text: Column) -> Column:
    """The probability that a text is good."""
    if not model.weights:
        return F.lit(float(model.constant))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(model.good, model.bad)
        for texts in batches:
            yield pd.Series(score_texts(model, texts.tolist(), sizes), dtype="float64")

    return F.pandas_udf(scored, "double")(text)


def quality_model(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from the training folds of ``labels(doc_id, quality)``."""
    sample = labelled_sample(docs, labels, "quality", PER_CLASS, SAMPLE_CHARS)
    return train_quality(sample[1], sample[0], label_share(labels, "quality"))


def with_quality(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text.

    A null text is scored as the empty one, which gets a defined score like any
    other; equal texts get equal scores; an empty table stays empty. Without
    labels of both classes every score is the share of good labels. A column
    that is named like the result is an error.
    """
    new_name(docs, name)
    ship(docs.sparkSession)
    return docs.withColumn(name, quality_score(model, text_of()))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns.

    Null texts are scored as empty ones; repeated rows stay or go together; an
    empty table stays empty; columns may have any names.
    """
    ship(docs.sparkSession)
    return docs.where(quality_score(model, text_of()) >= threshold)


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs, model).select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
