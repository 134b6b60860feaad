"""The compression classifier on held-out labelled texts, and its cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import quality as Q
from kinfold.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_on_whole_documents(spark):
    found = Q.op6_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out")
    rows = [(r.predicted, r.quality) for r in found.select("predicted", "quality").collect()]
    good = [p for p, y in rows if y == 1]
    bad = [p for p, y in rows if y == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_spark_equals_plain_scores_and_cases(spark):
    good, bad = ["The cat sat on the mat, %d times." % i * 5 for i in range(60)], ["BUY!! NOW!! %d " % i * 9 for i in range(60)]
    model = Q.train_quality(good, bad, 0.8)
    texts = ["", None, good[0], bad[0], "é" * 100_000, good[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in Q.with_quality(docs, model, "q").select("doc_id", F.col("q").alias("score")).collect()}
    want = Q.score_texts(model, [t or "" for t in texts], Q._Sizes(model.good, model.bad))
    assert [got[i] for i in range(len(texts))] == want.tolist()
    with pytest.raises(ValueError, match="columns named"):
        Q.with_quality(docs, model, "Score")
    assert got[0] == got[1] and got[2] == got[5] and got[2] > 0.5 > got[3] and all(0 <= s <= 1 for s in got.values())
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and {2, 5} <= {r.doc_id for r in kept.collect()} and 3 not in {r.doc_id for r in kept.collect()}


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = Q.quality_model(docs, labels)
    assert 0 <= Q.with_quality(docs, model).first().score <= 1
    assert Q.with_quality(docs.limit(0), model).count() == 0
    assert Q.quality_model(docs.limit(0), labels.limit(0)).constant == 0.5
