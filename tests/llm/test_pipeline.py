"""The pipeline against its stages in plain Python, and on awkward tables."""

import collections


import corpus_pipeline as C
from kinfold.llm import mixing, quality
from kinfold.llm.common import materialize, table
from test_exact_dedup import brute as brute_groups
from test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    source = table(spark, SF, "documents")
    model = quality.quality_model(source, table(spark, SF, "labels"))
    rows = source.orderBy("doc_id").collect()
    score = quality.score_texts(model, [r.text or "" for r in rows], quality._Sizes(model.good, model.bad))
    good = [r for r, s in zip(rows, score) if s >= quality.THRESHOLD]
    assert sorted(r.doc_id for r in seen["quality"]) == [r.doc_id for r in good]
    kept = {i for i, k, _, stays, _ in brute_groups([(r.doc_id, r.text, None) for r in good]) if stays}
    assert {r.doc_id for r in seen["exact_dedup"]} == kept and len(seen["exact_dedup"]) == len(kept)
    left = [r for r in good if r.doc_id in kept]
    prints = [slow_fingerprint(r.text) for r in left]
    least = {}
    for r, root in zip(left, slow_components(prints)):
        least[root] = min(r.doc_id, least.get(root, r.doc_id))
    assert sorted(r.doc_id for r in seen["simhash"]) == sorted(least.values())
    copies = collections.Counter(r.doc_id for r in seen["mixing"])
    plan = mixing.mixing_plan(spark.createDataFrame(seen["simhash"], source.schema)).collect()
    assert {r.doc_id: r.copies for r in plan if r.copies} == dict(copies)
    tokens = collections.defaultdict(int)
    for r in seen["packing"]:
        tokens[r.doc_id] += r.length
    whole = {r.doc_id: r.doc_tokens for r in seen["packing"]}
    assert {i: whole[i] * n for i, n in copies.items()} == dict(tokens)


def test_awkward_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, row long"
    rows = [
        (None, None, None, None, None, 1, 1),
        (None, None, None, None, None, 1, 1),
        (1, "", "en", "s", 0, None, None),
        (2, "a b c d e", "en", "s", 9, 1, 1),
        (2, "a b c d e", "en", "s", 9, 1, 1),
        (3, "word " * 50_000, "en", None, 250_000, 1, 1),
    ]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in C.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            assert name == "packing" or docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert (docs.count() > 0) == bool(part)


def test_registered(spark):
    assert list(C.queries()) == ["pipeline"] and C.run(spark, SF).count() > 0
