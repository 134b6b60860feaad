"""Count, binary and TF-IDF vectors over a fitted vocabulary.

Two forms are used. Long: ``(id, term_id, value)``. Packed, one row per
article: ``(id, idx ARRAY<INT>, val ARRAY<DOUBLE>)`` with ascending ``idx``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.functions.vectors import scale_by_norm
from kinfold.operators.ordering import BROADCAST_ROWS, lookup_join, rank_distinct
from kinfold.session import materialize, ship, spread


def tokenized(
    df: DataFrame,
    id_col: str,
    content: str,
    tokenizer: Callable[[Column], Column] | None = None,
    stop_words: list[str] | str | None = None,
    extra: list[str] | None = None,
) -> DataFrame:
    """``(id, tokens)``. ``tokenizer`` is any Column -> ARRAY<STRING> function."""
    tokens = (tokenizer or T.word_tokens)(F.col(content))
    if isinstance(stop_words, str):
        stop_words = T.default_stop_words(stop_words)
    if stop_words:
        tokens = T.remove_stop_words(tokens, stop_words)
    rows = spread(df.select(id_col, *(extra or []), content), id_col)
    return rows.select(id_col, *(extra or []), tokens.alias("tokens"))


def counted(tokens: DataFrame, id_col: str, extra: list[str] | None = None) -> DataFrame:
    """``(id, terms)``: distinct terms with counts. Storing this once spares the
    later passes the tokenizer; all functions below accept it for ``tokens``."""
    return tokens.select(id_col, *(extra or []), T.term_counts(F.col("tokens")).alias("terms"))


def _terms(df: DataFrame) -> Column:
    return F.col("terms") if "terms" in df.columns else T.term_counts(F.col("tokens"))


def document_terms(tokens: DataFrame, id_col: str) -> DataFrame:
    """``(id, term, n)`` counted inside each row; rows without terms keep a null term."""
    return tokens.select(id_col, F.explode_outer(_terms(tokens)).alias("_t")).select(
        id_col, F.col("_t.term").alias("term"), F.col("_t.n").alias("n")
    )


def _bound(limit: int | float, n_docs: int) -> float:
    """A float is a share of the documents, an int a number of them."""
    return limit * n_docs if isinstance(limit, float) else limit


def fit_vocab(
    tokens: DataFrame,
    id_col: str,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    max_features: int | None = None,
    n_docs: int | None = None,
) -> DataFrame:
    """``(term_id, term, df, tf)``: terms inside the document-frequency bounds.

    ``max_features`` keeps the most frequent terms, ties in term order; indices
    follow term order.
    """
    if n_docs is None:
        n_docs = tokens.count()
    terms = tokens.select(F.explode(_terms(tokens)).alias("_t"))
    stats = (
        terms.groupBy(F.col("_t.term").alias("term"))
        .agg(F.count(F.lit(1)).alias("df"), F.sum("_t.n").alias("tf"))
        .filter((F.col("df") >= _bound(min_df, n_docs)) & (F.col("df") <= _bound(max_df, n_docs)))
    )
    stats = materialize(stats, "terms")
    if max_features is not None:
        stats = _most_frequent(stats, max_features)
    ranked = rank_distinct(stats, [F.col("term")], "_rank", "vocab")
    vocab = ranked.select(F.col("_rank").cast("int").alias("term_id"), "term", "df", "tf")
    return materialize(vocab, "vocab")


def _most_frequent(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of highest ``tf``, ties in term order.

    Frequencies are few compared with terms: their counts give the frequency at
    which the k-th term stands. All terms above it stay; only its own terms are
    ranked.
    """
    counts = stats.groupBy("tf").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("tf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    cut = counts.where((F.col("above") < k) & (F.col("above") + F.col("n") > k)).first()
    if cut is None:  # all terms, or whole frequencies
        least = counts.where(F.col("above") < k).agg(F.min("tf")).first()[0]
        return stats if least is None else stats.where(F.col("tf") >= least)
    tied = rank_distinct(stats.where(F.col("tf") == cut["tf"]), [F.col("term")], "_rank", "ties")
    tied = tied.where(F.col("_rank") < k - cut["above"]).drop("_rank")
    return stats.where(F.col("tf") > cut["tf"]).unionByName(tied)


VOCAB_BYTES = 64 << 20
_ENTRIES = 1 << 18  # terms that a task looks up at once


def _held(vocab: DataFrame, *columns: str) -> dict[str, np.ndarray | pa.Array] | None:
    """The vocabulary by term_id, if its rows and its bytes are few enough to send to the tasks."""
    size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if size[0] > BROADCAST_ROWS or size[1] > VOCAB_BYTES:
        return None
    rows = vocab.select("term", *columns).toArrow()
    order = pc.sort_indices(rows.column("term_id")) if "term_id" in columns else None
    rows = rows.take(order) if order is not None else rows
    held = {c: rows.column(c).combine_chunks() for c in ("term", *columns)}
    return {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in held.items()}


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _looked_up(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, positions in the vocabulary and counts of a batch's known terms, by row and position."""
    column = batch.column("terms")
    inner = column.flatten()
    starts = column.offsets.to_numpy() - column.offsets[0].as_py()
    row = np.repeat(np.arange(len(column)), np.diff(starts))
    found = pc.index_in(inner.field("term"), value_set=terms)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    at = found.fill_null(-1).to_numpy()[known]
    row, n = row[known], inner.field("n").to_numpy()[known]
    order = np.lexsort((at, row))
    counts = np.bincount(row, minlength=len(column))
    return np.concatenate([[0], np.cumsum(counts)]), at[order], n[order].astype(np.float64)


def _by_entries(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``_ENTRIES`` list entries, or of one row."""
    ends = batch.column(column).offsets.to_numpy()[1:]
    start = 0
    while start < batch.num_rows:
        before = batch.column(column).offsets[start].as_py()
        end = max(int(ends.searchsorted(before + _ENTRIES, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _map_terms(tokens: DataFrame, id_col: str, held: dict, make, columns: str) -> DataFrame:
    """Look the terms up inside each row, so that no entry leaves its article."""
    spark = tokens.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(held)
    rows = tokens.select(id_col, _terms(tokens).alias("terms"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in _by_entries(batch, "terms"):
                made = make(table, *_looked_up(part, table["term"]))
                yield pa.RecordBatch.from_arrays([part.column(0), *made.values()], names=[id_col, *made])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def count_packed(tokens: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """Packed counts; articles without a known term stay as empty rows."""
    if (held := _held(vocab, "term_id")) is not None:

        def packed(table, offsets, at, n):
            ids = table["term_id"].to_numpy()[at]
            return {"idx": _lists(offsets, ids.astype(np.int32)), "val": _lists(offsets, n)}

        return _map_terms(tokens, id_col, held, packed, "idx array<int>, val array<double>")
    terms = document_terms(tokens, id_col)
    known = lookup_join(terms, vocab.select("term", "term_id"), "term", "left", salt_on=id_col, stored=True)
    entry = F.when(
        F.col("term_id").isNotNull(),
        F.struct(F.col("term_id").alias("i"), F.col("n").cast("double").alias("v")),
    )
    grouped = known.groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return grouped.select(id_col, F.col("_e.i").alias("idx"), F.col("_e.v").alias("val"))


def to_long(packed: DataFrame, id_col: str) -> DataFrame:
    """Packed to long; empty rows have no entries in the long form."""
    pairs = F.explode(F.arrays_zip("idx", "val")).alias("_e")
    return packed.select(id_col, pairs).select(
        id_col, F.col("_e.idx").cast("int").alias("term_id"), F.col("_e.val").cast("double").alias("value")
    )


def to_packed(features: DataFrame, id_col: str) -> DataFrame:
    """Long to packed, entries in term order (the COO triple of one row)."""
    entry = F.struct(F.col("term_id").alias("i"), F.col("value").alias("v"))
    return (
        features.groupBy(id_col)
        .agg(F.sort_array(F.collect_list(entry)).alias("_e"))
        .select(id_col, F.col("_e.i").alias("idx"), F.col("_e.v").alias("val"))
    )


def count_transform(tokens: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """Long counts restricted to the vocabulary; no regrouping by article."""
    terms = document_terms(tokens, id_col).filter(F.col("term").isNotNull())
    known = lookup_join(terms, vocab.select("term", "term_id"), "term", "inner", salt_on=id_col, stored=True)
    return known.select(id_col, "term_id", F.col("n").cast("double").alias("value"))


def binarise(df: DataFrame) -> DataFrame:
    """Every stored value becomes 1, in either form."""
    if "val" in df.columns:
        return df.withColumn("val", F.transform("val", lambda _: F.lit(1.0)))
    return df.withColumn("value", F.lit(1.0))


def idf_of(n_docs: int, df: Column, smooth: bool = True) -> Column:
    add = 1 if smooth else 0
    return F.ln(F.lit(float(n_docs + add)) / (df + F.lit(add))) + F.lit(1.0)


def fit_idf(vocab: DataFrame, n_docs: int, smooth: bool = True) -> DataFrame:
    """``(term_id, idf)`` from the document frequencies of the fitted vocabulary."""
    return vocab.select("term_id", idf_of(n_docs, F.col("df"), smooth).alias("idf"))


def fit_idf_counts(packed: DataFrame, n_features: int, smooth: bool = True) -> DataFrame:
    """``(term_id, idf)`` from any count relation, unseen terms included."""
    n_docs = packed.count()
    spark = packed.sparkSession
    seen = packed.select(F.explode("idx").alias("term_id")).groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    every = spark.range(n_features).select(F.col("id").cast("int").alias("term_id"))
    return every.join(seen, "term_id", "left").select(
        "term_id", idf_of(n_docs, F.coalesce(F.col("df"), F.lit(0)), smooth).alias("idf")
    )


def _held_idf(idf: DataFrame) -> np.ndarray | None:
    """The idf by term_id, if it is short enough to send to the tasks."""
    last = idf.agg(F.max("term_id")).first()[0]
    if last is None or last >= BROADCAST_ROWS:
        return None
    rows = idf.select("term_id", "idf").toArrow()
    held = np.full(last + 1, np.nan)
    held[rows.column("term_id").to_numpy()] = rows.column("idf").to_numpy()
    return held


def _map_idf(packed: DataFrame, id_col: str, held: np.ndarray) -> DataFrame:
    spark = packed.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(held)
    kind = packed.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            idx, val = batch.column("idx"), batch.column("val")
            starts = idx.offsets.to_numpy() - idx.offsets[0].as_py()
            weight = val.flatten().to_numpy() * table[idx.flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), idx, _lists(starts, weight)], names=[id_col, "idx", "val"])

    return packed.mapInArrow(run, f"`{id_col}` {kind}, idx array<int>, val array<double>")


def tfidf_transform(
    packed: DataFrame,
    idf: DataFrame | None,
    id_col: str,
    norm: str = "l2",
    use_idf: bool = True,
    sublinear_tf: bool = False,
) -> DataFrame:
    """Packed counts to packed TF-IDF rows."""
    tf = F.transform("val", lambda v: F.ln(v) + 1.0) if sublinear_tf else F.col("val")
    weighted = packed.select(id_col, "idx", tf.alias("val"))
    if use_idf and (held := _held_idf(idf)) is not None:
        weighted = _map_idf(weighted, id_col, held)
    elif use_idf:
        entries = weighted.select(id_col, F.explode_outer(F.arrays_zip("idx", "val")).alias("_e")).select(
            id_col, F.col("_e.idx").alias("term_id"), F.col("_e.val").alias("_tf")
        )
        known = lookup_join(entries, idf, "term_id", "left", salt_on=id_col, stored=True)
        entry = F.when(
            F.col("term_id").isNotNull(),
            F.struct(F.col("term_id").alias("i"), (F.col("_tf") * F.col("idf")).alias("v")),
        )
        weighted = (
            known.groupBy(id_col)
            .agg(F.sort_array(F.collect_list(entry)).alias("_e"))
            .select(id_col, F.col("_e.i").alias("idx"), F.col("_e.v").alias("val"))
        )
    return weighted.select(id_col, "idx", scale_by_norm(F.col("val"), norm or "").alias("val"))


def vectorize(
    tokens: DataFrame,
    vocab: DataFrame,
    id_col: str,
    n_docs: int,
    norm: str = "l2",
    use_idf: bool = True,
    smooth_idf: bool = True,
    sublinear_tf: bool = False,
) -> DataFrame:
    """``(id, idx, val, tfidf)`` in one pass: counts and TF-IDF of the same rows.

    The vocabulary carries the document frequencies, so one lookup yields the
    index and the idf, and one regrouping by article serves both vectors.
    """
    table = vocab.select("term", "term_id", idf_of(n_docs, F.col("df"), smooth_idf).alias("idf"))
    if (held := _held(table, "term_id", "idf")) is not None:

        def weighted(table, offsets, at, n):
            tf = np.log(n) + 1.0 if sublinear_tf else n
            weight = tf * table["idf"].to_numpy()[at] if use_idf else tf
            ids = table["term_id"].to_numpy()[at].astype(np.int32)
            return {"idx": _lists(offsets, ids), "val": _lists(offsets, n), "w": _lists(offsets, weight)}

        rows = _map_terms(tokens, id_col, held, weighted, "idx array<int>, val array<double>, w array<double>")
        return rows.select(id_col, "idx", "val", scale_by_norm(F.col("w"), norm or "").alias("tfidf"))
    terms = document_terms(tokens, id_col)
    known = lookup_join(terms, table, "term", "left", salt_on=id_col, stored=True)
    n = F.col("n").cast("double")
    tf = F.ln(n) + 1.0 if sublinear_tf else n
    weight = tf * F.col("idf") if use_idf else tf
    entry = F.when(
        F.col("term_id").isNotNull(), F.struct(F.col("term_id").alias("i"), n.alias("v"), weight.alias("w"))
    )
    grouped = known.groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return grouped.select(
        id_col,
        F.col("_e.i").alias("idx"),
        F.col("_e.v").alias("val"),
        scale_by_norm(F.col("_e.w"), norm or "").alias("tfidf"),
    )


def fit_tfidf(
    tokens: DataFrame,
    id_col: str,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    max_features: int | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and TF-IDF fitted on the same rows (one-step or re-fit use)."""
    n_docs = tokens.count()
    vocab = fit_vocab(tokens, id_col, min_df, max_df, max_features, n_docs)
    rows = vectorize(tokens, vocab, id_col, n_docs, **options)
    return vocab, rows.select(id_col, "idx", F.col("tfidf").alias("val"))


def inverse_terms(tokens: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """``(id, terms)``: distinct vocabulary terms per article, in term order."""
    if (held := _held(vocab, "term_id")) is not None:

        def named(table, offsets, at, n):
            return {"terms": _lists(offsets, table["term"].take(pa.array(at)))}

        return _map_terms(tokens, id_col, held, named, "terms array<string>")
    terms = document_terms(tokens, id_col)
    known = lookup_join(terms, vocab.select("term", "term_id"), "term", "left", salt_on=id_col, stored=True)
    term = F.when(F.col("term_id").isNotNull(), F.col("term"))
    return known.groupBy(id_col).agg(F.sort_array(F.collect_list(term)).alias("terms"))


def matrix_extremes(packed: DataFrame, n_features: int) -> DataFrame:
    """Global minimum and maximum; implicit zeros count."""
    low = F.least(
        F.array_min("val"), F.when(F.size("val") < n_features, F.lit(0.0))
    )
    high = F.greatest(F.array_max("val"), F.when(F.size("val") < n_features, F.lit(0.0)))
    return packed.agg(F.min(low).alias("min_value"), F.max(high).alias("max_value"))
