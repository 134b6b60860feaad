"""The string kernel against its definition, and the classifier on held-out labelled texts."""

import itertools
import random

import numpy as np
import pytest

from kinfold.llm import toxicity as T
from kinfold.llm.common import table

SF = "/root/testdata/sf0.1"


def slow_kernel(a, b):
    def triples(word):
        word = "^" + word
        out = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < T.SPAN:
                t = word[i] + word[j] + word[k]
                out[t] = out.get(t, 0) + T.DECAY ** (k - i - 2)
        return out

    x, y = triples(a), triples(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def test_kernel_equals_its_definition():
    words = ["idiot", "i.d.i.o.t", "idxiot", "banana", "a", "", "abcabcabc", "x" * 20]
    kernel = T.Kernel("abcdefghijklmnopqrstuvwxyz.")
    known = np.unique(np.concatenate([f.ravel() for f, _ in kernel.triples(words)]))
    rows = kernel.rows(words, known[known >= 0])
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert np.isclose(rows[i] @ rows[j], slow_kernel(words[i], words[j]), rtol=1e-4)
    weights = np.zeros(T.SYMBOLS**3 + 1, np.float32)
    weights[known[known >= 0]] = rows[0]
    assert np.allclose(kernel.sums(words, weights), rows @ rows[0], rtol=1e-4)


def test_words_windows_and_spelled_words():
    assert "idiot" in T.words_of("you I D I O T there") and T.words_of("") == []
    long = "ab" * 100
    assert "".join(dict.fromkeys("".join(T._windows(long)))) == "ab" and all(len(w) <= T.LONGEST for w in T._windows(long))
    assert T._windows("i.d.i.o.t") == ["i.d.i.o.t", "idiot"]


def test_held_out_accuracy_and_disguised_words(spark):
    found = T.op5_toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out")
    rows = found.select("score", "predicted", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    below = (score[toxic == 1][:, None] > score[toxic == 0][None]).mean()
    assert below > 0.9 and np.mean([r.predicted == r.toxic for r in rows]) > 0.93


def test_cases(spark):
    draw = random.Random(1)
    plain = "weather town fine people went walk again they sang river house green little summer".split()
    some = lambda n: " ".join(draw.choice(plain) for _ in range(n))
    clean = [f"{some(8)}. {some(9)}" for _ in range(80)]
    toxic = [f"{some(4)} idiot {some(3)}. {some(3)} moron {some(4)}" for _ in range(80)]
    model = T.train_toxicity(toxic, clean, 0.3)
    texts = ["", None, clean[0], toxic[0], "what an i.d.i.o.t he is", "x" * 100_000, toxic[0], "fine people " * 20_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in T.with_toxicity(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] and got[3] == got[6] > 0.5 > max(got[0], got[2], got[7])
    assert got[4] > got[2]
    assert T.with_toxicity(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="columns named"):
        T.with_toxicity(docs, model, "TEXT")
    assert T.train_toxicity([], clean, 0.0).weights == ()
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    constant = T.toxicity_model(docs, labels)
    assert T.with_toxicity(docs, constant).first().score == constant.constant


def _texts(draw, n, *insults):
    plain = "weather town fine people went walk again they sang river house green little summer".split()
    some = lambda k: " ".join(draw.choice(plain) for _ in range(k))
    return [". ".join(f"{some(4)} {i} {some(3)}".replace("  ", " ") for i in insults) for _ in range(n)]


def _scores(spark, model, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.score for r in T.with_toxicity(docs, model).orderBy("doc_id").collect()]


def test_joins_equal_their_words():
    words = "you stu pid man. mo ron x - y i am here".split() + ["z" * 100, "stu", "pid"]
    kernel = T.Kernel("abcdefghijklmnopqrstuvwxyz")
    weights = np.random.default_rng(1).normal(size=T.SYMBOLS**3 + 1).astype(np.float32)
    weights[-1] = 0
    part = T._reach(words)
    got = T.score_joins(kernel, weights, 0.5, words, part)
    for wide, i in itertools.product(range(2, T.WIDEST + 1), range(len(words))):
        own = words[i : i + wide]
        text = T._joined(words, i, wide)
        whole = len(own) == wide and not any(w.endswith(".") or len(w) > 64 for w in own[:-1]) and len(own[-1]) <= 64
        if whole and len(text) > 2 and own[0] != "-" and own[-1] != "-":
            assert np.isclose(got[wide - 2, i], T.score_words(kernel, weights, 0.5, [text])[0], atol=1e-3), own
        else:
            assert got[wide - 2, i] == -np.inf, own


def test_insults_in_parts(spark):
    draw = random.Random(3)
    model = T.train_toxicity(_texts(draw, 80, "stupid", "moron"), _texts(draw, 80, "", ""), 0.3)
    parts = ["stu pid|mo\nron", "s tup id|mor  on", "s  t  u  p  i  d|m\no\nr\no\nn"]
    texts = [_texts(draw, 1, *p.split("|"))[0] for p in ["stupid|moron", *parts, "|", "fine|town"]]
    got = _scores(spark, model, texts)
    assert min(got[:4]) > 0.5 > max(got[4:]), got


def test_insults_of_ordinary_words(spark):
    draw = random.Random(4)
    clean = _texts(draw, 150, "", "broken", "", "record")
    model = T.train_toxicity(_texts(draw, 150, "broken record", "", "broken record"), clean, 0.3)
    got = _scores(spark, model, [*_texts(draw, 3, "broken record", "", "broken record"), *clean[:5]])
    assert min(got[:3]) > 0.5 > max(got[3:]), got
