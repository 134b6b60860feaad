import pytest
from pyspark.sql import functions as F

from kinfold.sources import articles as SA
from kinfold.sources import bundle as SB
from kinfold.sources import files as SF


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet"])
def test_tables(spark, tmp_path, fmt):
    rows = [(1, "a,b\t\"q\"\nline", None, 1.5), (2, "", " pad ", -2.0), (3, "港", "x", None)]
    df = spark.createDataFrame(rows, "key long, d2 string, d3 string, d4 double")
    path = str(tmp_path / f"t.{fmt}")
    SF.write_table(df, path)
    back = SF.read_table(spark, path, schema=None if fmt == "parquet" else df.schema, key="key", multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows
    with pytest.raises(ValueError, match="key column"):
        SF.read_table(spark, path, key="nope")


def test_inferred_types_and_bad_format(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    SF.write_table(spark.sql("select timestamp'2020-01-02 03:04:05' as k, 7 as v"), path)
    assert [f.dataType.typeName() for f in SF.read_table(spark, path).schema] == ["timestamp", "integer"]
    with pytest.raises(ValueError, match="format should be"):
        SF.file_format("x.npy")
    with pytest.raises(Exception, match="(?i)path"):
        SF.read_table(spark, str(tmp_path / "missing.csv"))


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_matrices_and_series(spark, tmp_path, fmt):
    dense = spark.createDataFrame([(i, [i + 0.25, -1.0, 1e-7]) for i in range(40)], "id long, vec array<double>")
    SF.write_matrix(dense.repartition(5), str(tmp_path / f"d.{fmt}"), "id")
    back = SF.read_matrix(spark, str(tmp_path / f"d.{fmt}")).orderBy("row").collect()
    assert [(r.row, list(r.vec)) for r in back] == [(i, [i + 0.25, -1.0, 1e-7]) for i in range(40)]
    sparse = spark.createDataFrame([(0, [1, 3], [2.0, 5.0]), (1, [], [])], "id long, idx array<int>, val array<double>")
    SF.write_matrix(sparse, str(tmp_path / f"s.{fmt}"), "id", n_features=4)
    got = SF.read_matrix(spark, str(tmp_path / f"s.{fmt}"), sparse=True).collect()
    assert {(r.row, r.term_id, r.value) for r in got} == {(0, 1, 2.0), (0, 3, 5.0)}
    assert SF.read_matrix(spark, str(tmp_path / f"s.{fmt}")).count() == 2
    series = spark.createDataFrame([(1, "a"), (2, "b,\tc")], "key long, value string")
    SF.write_series(series, str(tmp_path / f"r.{fmt}"))
    again = SF.read_series(spark, str(tmp_path / f"r.{fmt}"), "key long, value string")
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "b,\tc")]


def test_tool_output_and_labelled_text(spark, tmp_path):
    path = tmp_path / "out.txt"
    path.write_text("h1\nh2\nh3\nin0\n0.5 1 \nin1\n-2 3e-1 \n")
    got = SA.read_embeddings(spark, str(path), raw=True).orderBy("row").collect()
    assert [(r.row, list(r.vec)) for r in got] == [(0, [0.5, 1.0]), (1, [-2.0, 0.3])]
    terms = spark.createDataFrame([(1, ["a", "b"], "x"), (2, [], "y")], "id long, terms array<string>, c string")
    SA.write_labelled_text(terms, "c", "id", str(tmp_path / "l"))
    assert [r.value for r in SF.numbered_lines(spark, str(tmp_path / "l")).orderBy("row").collect()] == [
        "a b __label__x",
        " __label__y",
    ]


def test_article_schema_is_checked(spark, tmp_path):
    spark.sql("select 'a' as article_id, 't' as title, 'c' as main_content").write.parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError, match="integer"):
        SA.read_articles(spark, str(tmp_path / "a"))
    spark.sql("select 1 as article_id").write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="lacks"):
        SA.read_articles(spark, str(tmp_path / "b"))


def test_bundle_and_params(spark, tmp_path):
    vectors = spark.createDataFrame(
        [(1, [0], [2.0], [1.0], "train"), (2, [1], [3.0], [0.5], "validate")],
        "id long, idx array<int>, val array<double>, tfidf array<double>, split string",
    )
    features = SB.feature_rows(vectors, F.col("split")).unionByName(SB.feature_rows(vectors, F.col("split"), "pos"))
    rows = spark.createDataFrame([(1, "train"), (2, "validate")], "id long, split string")
    vocab = spark.createDataFrame([(0, "a", 1.0)], "term_id int, term string, idf double")
    SB.Bundle(rows, features, rows.withColumn("label", F.lit(0)), vocab).save(str(tmp_path / "b"))
    back = SB.Bundle.restore(spark, str(tmp_path / "b"))
    assert back.articles.count() == 2
    assert [(r.id, r.val) for r in back.rows("binary", "train").collect()] == [(1, [1.0])]
    assert [(r.id, r.val) for r in back.rows("tfidf", "validate", "pos").collect()] == [(2, [0.5])]
    path = str(tmp_path / "p")
    SB.write_params(spark, path, "r1", {"a": 1})
    SB.write_params(spark, path, "r2", {"a": 2})
    assert spark.read.parquet(path).count() == 2
    SB.write_params(spark, path, "r3", {"b": 3}, append=False)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("r3", "b", "3")]


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    from kinfold.sources.files import numbered_lines

    (tmp_path / "m").mkdir()
    lines = [f"{i},{'x' * (i % 50)}" for i in range(6000)]
    (tmp_path / "m" / "a.csv").write_text("\n".join(lines[:5000]) + "\n")
    (tmp_path / "m" / "b.csv").write_text("\n".join(lines[5000:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(tmp_path / "m")).rdd.getNumPartitions() > 4
        got = numbered_lines(spark, str(tmp_path / "m")).orderBy("row").collect()
        table = spark.read.text(str(tmp_path / "m" / "a.csv"))
        assert SF.read_series(spark, str(tmp_path / "m" / "a.csv"), "k long, v string").count() == table.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row, r.value) for r in got] == list(enumerate(lines))


def test_a_filled_matrix_is_written_by_many_tasks(spark, tmp_path):
    """Its zeros are few bytes in a shuffle and many in a file, so the parts must not be joined by the shuffled bytes."""
    packed = spark.range(64).select("id", F.array(F.lit(3), F.lit(0), F.lit(9)).alias("idx"), F.array(*map(F.lit, (1e10, 2.5, 7.0))).alias("val"))
    SF.write_matrix(packed.repartition(3), str(tmp_path / "m.tsv"), "id", n_features=4)
    assert len(list((tmp_path / "m.tsv").glob("part-*"))) >= spark.sparkContext.defaultParallelism
    assert [r.value for r in SF.numbered_lines(spark, str(tmp_path / "m.tsv")).orderBy("row").collect()] == ["2.5\t0.0\t0.0\t1.0E10"] * 64
    got = SF.read_matrix(spark, str(tmp_path / "m.tsv"), sparse=True).collect()
    assert sorted(map(tuple, got)) == [(r, i, v) for r in range(64) for i, v in ((0, 2.5), (3, 1e10))]


def test_texts_are_counted_once_for_a_query(spark, tmp_path, monkeypatch):
    """A bundle, and a resumed fit, take their vectors and vocabulary from one pass over the texts."""
    from kinfold.plans import encoder_queries, file_queries, inputs

    texts = ["alpha beta gamma", "beta gamma delta", "gamma delta alpha", "delta alpha beta"]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    calls, fitted = [], inputs.fitted
    monkeypatch.setattr(inputs, "fitted", lambda *args: calls.append(1) or fitted(*args))
    assert file_queries.QUERIES["bundle_articles"](spark, str(tmp_path)).count() == 4
    assert len(calls) == 1
    monkeypatch.setattr(encoder_queries, "_stepped", lambda rows, *args, **kw: _Stored(rows))
    monkeypatch.setattr(encoder_queries, "_summary", lambda model: model.rows)
    monkeypatch.setattr(encoder_queries.EncoderModel, "load", lambda *args: None)
    calls.clear()
    assert encoder_queries.QUERIES["fit_resumed_momentum"](spark, str(tmp_path)).count() == 4
    assert len(calls) == 1


class _Stored:
    def __init__(self, rows):
        self.rows = rows

    def save(self, path):
        pass


def test_zeros_of_a_packed_matrix_take_little_disk(spark, tmp_path):
    """Lines of explicit zeros are compressed, and read back in order from all files."""
    n, width = 300, 3000
    rows = [(i, [i % width, width - 1 - i % 7], [1.0 + i, 0.5]) for i in range(n)]
    packed = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").repartition(4)
    path = tmp_path / "wide.tsv"
    SF.write_matrix(packed, str(path), "id", n_features=width)
    assert sum(f.stat().st_size for f in path.glob("part-*")) < n * width // 10  # 4 bytes a cell in plain text
    got = {(r.row, r.term_id): r.value for r in SF.read_matrix(spark, str(path), sparse=True).collect()}
    assert got == {(i, j): v for i, idx, val in rows for j, v in zip(idx, val)}
