import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import vectorize as V

DOCS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "a cat and a dog and a cat"), (4, "?")]


@pytest.fixture
def tokens(spark):
    return V.tokenized(spark.createDataFrame(DOCS, "id long, t string"), "id", "t")


def rows(packed):
    return {r.id: dict(zip(r.idx, r.val)) for r in packed.collect()}


def test_vocabulary_bounds_and_order(tokens):
    every = [(r.term_id, r.term, r.df, r.tf) for r in V.fit_vocab(tokens, "id").orderBy("term_id").collect()]
    assert [x[1] for x in every] == ["and", "cat", "dog", "mat", "on", "sat", "the"]
    assert [x[0] for x in every] == list(range(7))
    assert every[1][2:] == (2, 3) and every[6][2:] == (2, 3)
    assert {r.term for r in V.fit_vocab(tokens, "id", min_df=2).collect()} == {"cat", "dog", "sat", "the"}
    assert {r.term for r in V.fit_vocab(tokens, "id", max_df=0.25).collect()} == {"and", "mat", "on"}
    top = V.fit_vocab(tokens, "id", max_features=3).orderBy("term_id").collect()
    assert [r.term for r in top] == ["and", "cat", "the"]  # ties by term


def test_large_vocabulary_path(tokens, monkeypatch):
    want = [(r.term_id, r.term) for r in V.fit_vocab(tokens, "id", max_features=4).orderBy("term_id").collect()]
    monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
    got = [(r.term_id, r.term) for r in V.fit_vocab(tokens, "id", max_features=4).orderBy("term_id").collect()]
    assert got == want


def test_counts_keep_empty_rows_and_agree_in_both_forms(tokens):
    vocab = V.fit_vocab(tokens, "id")
    packed = V.count_packed(tokens, vocab, "id")
    got = rows(packed)
    assert got[4] == {} and got[3] == {0: 2.0, 1: 2.0, 2: 1.0}
    long = {(r.id, r.term_id): r.value for r in V.count_transform(tokens, vocab, "id").collect()}
    assert long == {(i, t): v for i, d in got.items() for t, v in d.items()}
    back = rows(V.to_packed(V.to_long(packed, "id"), "id"))
    assert back == {i: d for i, d in got.items() if d}
    assert rows(V.binarise(packed))[3] == {0: 1.0, 1: 1.0, 2: 1.0}
    counted = V.counted(tokens, "id")
    assert rows(V.count_packed(counted, vocab, "id")) == got


@pytest.mark.parametrize("norm", ["l2", "l1", "max", ""])
@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf(tokens, norm, sublinear):
    vocab = V.fit_vocab(tokens, "id")
    packed = V.count_packed(tokens, vocab, "id")
    df = {r.term_id: r.df for r in vocab.collect()}
    got = rows(V.tfidf_transform(packed, V.fit_idf(vocab, 4), "id", norm, True, sublinear))
    one = V.vectorize(tokens, vocab, "id", 4, norm, sublinear_tf=sublinear)
    same = rows(one.select("id", "idx", F.col("tfidf").alias("val")))
    for i, counts in rows(packed).items():
        w = {t: (1 + math.log(c) if sublinear else c) * (math.log(5 / (1 + df[t])) + 1) for t, c in counts.items()}
        size = {
            "l2": math.sqrt(sum(x * x for x in w.values())),
            "l1": sum(w.values()),
            "max": max(w.values(), default=1),
            "": 1,
        }[norm]
        assert got[i] == pytest.approx({t: x / size for t, x in w.items()})
        assert same[i] == pytest.approx(got[i])


def test_idf_from_counts_covers_unseen_terms(tokens):
    vocab = V.fit_vocab(tokens, "id")
    packed = V.count_packed(tokens, vocab, "id").filter("id <= 2")
    idf = {r.term_id: r.idf for r in V.fit_idf_counts(packed, 7).collect()}
    assert idf[0] == pytest.approx(math.log(3 / 1) + 1) and idf[6] == pytest.approx(math.log(3 / 3) + 1)


def test_inverse_terms_and_extremes(tokens):
    vocab = V.fit_vocab(tokens, "id", min_df=2)
    got = {r.id: r.terms for r in V.inverse_terms(tokens, vocab, "id").collect()}
    assert got == {1: ["cat", "sat", "the"], 2: ["dog", "sat", "the"], 3: ["cat", "dog"], 4: []}
    low, high = V.matrix_extremes(V.count_packed(tokens, vocab, "id"), 4).first()
    assert (low, high) == (0.0, 2.0)


def test_custom_tokenizer_and_stop_words(spark):
    df = spark.createDataFrame([(1, "x-y-x")], "id long, t string")
    toks = V.tokenized(df, "id", "t", tokenizer=lambda c: F.split(c, "-"), stop_words=["y"])
    assert toks.first().tokens == ["x", "x"]


def test_terms_are_looked_up_in_bounded_parts():
    """Parts of an Arrow batch hold a bounded number of terms; rows without terms and long rows stay whole."""
    import pyarrow as pa

    sizes = [0, 3, V._ENTRIES - 3, 1, 2 * V._ENTRIES, 0, 0, 5]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.zeros(ends[-1], np.int8)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), terms], ["id", "terms"])
    for part in (batch, batch.slice(1, 6)):
        found = list(V._by_entries(part, "terms"))
        assert [i for p in found for i in p.column("id").to_pylist()] == part.column("id").to_pylist()
        assert all(p.num_rows == 1 or len(p.column("terms").flatten()) <= V._ENTRIES for p in found)
