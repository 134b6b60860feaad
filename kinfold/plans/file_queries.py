"""Registered queries: what is written is read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder.model import EncoderModel, save_encoded
from kinfold.functions.vectors import rounded
from kinfold.operators import articles as A
from kinfold.operators import vectorize as V
from kinfold.plans import inputs as I
from kinfold.plans import sql as Q
from kinfold.plans.encoder_queries import _CONFIG, _XAVIER, _small
from kinfold.session import fresh_path
from kinfold.sources import articles as SA
from kinfold.sources import bundle as SB
from kinfold.sources import files as SF

QUERIES, ORACLES = {}, {}


def _add(oracle=None, name=None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if oracle:
            ORACLES[name or fn.__name__] = oracle
        return fn

    return register


_DOCS = "SELECT doc_id, lang, source, n_chars, md5(text) AS text FROM documents"


def _table_query(fmt):
    def run(spark, sf_dir):
        docs = I.table(spark, sf_dir, "documents")
        path = fresh_path(spark, "table") + "." + fmt
        SF.write_table(docs, path)
        back = SF.read_table(spark, path, schema=None if fmt == "parquet" else docs.schema, key="doc_id", multi_line=fmt != "parquet")
        return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text"))

    return run


for _fmt in ("csv", "tsv", "parquet"):
    _add(_DOCS, f"table_{_fmt}")(_table_query(_fmt))


_ARTICLES_BACK = f"""
WITH {Q.ARTICLES} SELECT doc_id AS article_id, md5(title) AS title, source AS story FROM articles
"""


@_add(_ARTICLES_BACK)
def read_articles(spark, sf_dir):
    path = fresh_path(spark, "articles")
    rows = I.articles(spark, sf_dir).withColumnRenamed("doc_id", "article_id").drop("source", "lang")
    SA.save_articles(rows, path)
    return SA.read_articles(spark, path).select("article_id", F.md5("title").alias("title"), "story")


@_add("SELECT doc_id AS key, source AS value FROM documents")
def series_tsv(spark, sf_dir):
    path = fresh_path(spark, "series") + ".tsv"
    SF.write_series(I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("value")), path)
    return SF.read_series(spark, path, "key bigint, value string")


_MATRIX = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT row, CAST(unnest(range(len(v))) AS INTEGER) AS column, unnest(list_transform(v, lambda x: {Q.r('x')})) AS value FROM e
"""


def _cells(back):
    """Every cell of a matrix that was read back."""
    return back.select("row", F.posexplode("vec").alias("column", "value")).withColumn("value", rounded(F.col("value")))


@_add(_MATRIX)
def matrix_csv(spark, sf_dir):
    path = fresh_path(spark, "matrix") + ".csv"
    SF.write_matrix(I.codes(spark, sf_dir), path, "vec_id")
    return _cells(SF.read_matrix(spark, path))


@_add(f"""
WITH {Q.VECTORS}, p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)
SELECT row, term_id, value FROM cnt JOIN p USING (doc_id)
""")
def matrix_sparse_tsv(spark, sf_dir):
    path = fresh_path(spark, "matrix") + ".tsv"
    SF.write_matrix(_small(spark, sf_dir, "count"), path, "doc_id", n_features=Q.MAX_FEATURES)
    return SF.read_matrix(spark, path, sparse=True)


@_add(f"""
WITH {Q.terms()}, {Q.vocab()},
g AS (SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms FROM dt JOIN vocab USING (term) GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, md5(concat(coalesce(terms, ''), ' __label__', lang)) AS line
FROM documents LEFT JOIN g USING (doc_id)
""")
def labelled_text_file(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    langs = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    path = fresh_path(spark, "lines")
    SA.write_labelled_text(V.inverse_terms(counted, voc, "doc_id").join(langs, "doc_id"), "lang", "doc_id", path)
    return SF.numbered_lines(spark, path).select("row", F.md5("value").alias("line"))


@_add(_MATRIX)
def embedding_text(spark, sf_dir):
    """Tool-like text (header, then input and vector in turn) trimmed and parsed."""
    codes = I.codes(spark, sf_dir)
    line = F.concat(F.concat_ws(" ", F.transform("vec", lambda x: x.cast("string"))), F.lit(" "))
    both = codes.select("vec_id", F.posexplode(F.array(F.lit("input"), line)).alias("at", "value"))
    head = spark.range(3).select((F.col("id") - 3).alias("vec_id"), F.lit(0).alias("at"), F.lit("header").alias("value"))
    path = fresh_path(spark, "tool")
    text = head.unionByName(both).repartitionByRange("vec_id").sortWithinPartitions("vec_id", "at")
    text.select("value").write.text(path)
    return _cells(SA.read_embeddings(spark, path, raw=True))


# A bundle whose positives and negatives are the next and the last but one document.
_SHIFTS = {"org": 0, "pos": 1, "neg": 2}
_SPLITS = """sp AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= count(*) OVER () // 2 THEN 'train' ELSE 'validate' END AS split
       FROM documents)"""


def _bundle(spark, sf_dir):
    """Articles, labels, vocabulary and vectors in three roles, written and restored."""
    rows, voc, n = I.fitted_vectors(spark, sf_dir, Q.MAX_FEATURES)
    articles = A.positional_split(I.articles(spark, sf_dir), "doc_id", rows.count() // 2, rows.count())
    split = articles.select("doc_id", "split")
    features = None
    for role, shift in _SHIFTS.items():
        moved = rows.withColumn("doc_id", F.col("doc_id") - shift).join(split, "doc_id")
        part = SB.feature_rows(moved, F.col("split"), role)
        features = part if features is None else features.unionByName(part)
    labels = A.factorize(articles.select("doc_id", "source", "split"), "source", "doc_id", "label_story")
    voc = voc.withColumn("idf", V.idf_of(n, F.col("df")))
    path = fresh_path(spark, "bundle")
    SB.Bundle(articles, features, labels, voc).save(path)
    return SB.Bundle.restore(spark, path)


_ROLES_SQL = " UNION ALL ".join(
    f"SELECT '{role}' AS role, doc_id - {shift} AS doc_id, doc_id AS of FROM documents" for role, shift in _SHIFTS.items()
)


@_add(f"""
WITH {Q.VECTORS}, {_SPLITS}, ro AS ({_ROLES_SQL}), every AS (
  SELECT 'count' AS kind, doc_id AS of, term_id, value FROM cnt UNION ALL
  SELECT 'binary', doc_id, term_id, 1.0 FROM cnt UNION ALL SELECT 'tfidf', doc_id, term_id, value FROM tfidf)
SELECT kind, role, split, doc_id, term_id, {Q.r('value')} AS value FROM every JOIN ro USING (of) JOIN sp USING (doc_id)
""")
def bundle(spark, sf_dir):
    """Every value of every kind and role."""
    cells = _bundle(spark, sf_dir).features.select("kind", "role", "split", "doc_id", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    value = rounded(F.col("e.val")).alias("value")
    return cells.select("kind", "role", "split", "doc_id", F.col("e.idx").cast("int").alias("term_id"), value)


@_add(f"""
WITH {Q.ARTICLES}, {_SPLITS}, s AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY source)
SELECT doc_id, split, md5(main_content) AS main_content, md5(title) AS title, category_publish_name, a.source, lang,
       CAST(code AS INTEGER) AS label_story
FROM articles a JOIN sp USING (doc_id) JOIN s ON s.source = a.source
""")
def bundle_articles(spark, sf_dir):
    """Every column of the articles and labels of a restored bundle."""
    back = _bundle(spark, sf_dir)
    labels = back.labels.select("doc_id", F.col("split").alias("own"), "label_story")
    rows = back.articles.join(labels, "doc_id").where("split = own").drop("own")
    return rows.withColumn("main_content", F.md5("main_content")).withColumn("title", F.md5("title"))


@_add(f"""
WITH {Q.terms()}, {Q.vocab()}
SELECT term_id, term, df, tf, {Q.r('ln((1.0 + n_docs) / (1 + df)) + 1')} AS idf FROM vocab, nd
""")
def bundle_vocab(spark, sf_dir):
    voc = _bundle(spark, sf_dir).vocab
    return voc.select(F.col("term_id").cast("int").alias("term_id"), "term", "df", "tf", rounded(F.col("idf")).alias("idf"))


@_add("""
SELECT lang AS split, 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY lang
UNION ALL SELECT lang, 'sources', CAST(count(DISTINCT source) AS VARCHAR) FROM documents GROUP BY lang
""")
def run_params(spark, sf_dir):
    path = fresh_path(spark, "params")
    found = I.table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources")
    )
    for i, row in enumerate(found.collect()):  # one row per language
        SB.write_params(spark, path, row["lang"], {"rows": row["rows"], "sources": row["sources"]}, append=i > 0)
    return spark.read.parquet(path).withColumnRenamed("run_id", "split")


def _stored_model(spark, sf_dir):
    """A model stored and restored, and the folder of its codes of the documents and its weights."""
    path = fresh_path(spark, "model")
    EncoderModel.initial(spark, _CONFIG, Q.MAX_FEATURES).save(path)
    model = EncoderModel.load(spark, path)
    target = fresh_path(spark, "encoded")
    save_encoded(model, model.transform(_small(spark, sf_dir, "tfidf"), "doc_id"), target)
    return target


@_add(f"""
WITH {Q.VECTORS}, {_XAVIER},
act AS (SELECT doc_id, component, sum(f.value * w.w) AS a FROM tfidf f JOIN w USING (term_id) GROUP BY ALL)
SELECT d.doc_id, c.component, {Q.r('1 / (1 + exp(-coalesce(a, 0))) - 0.5')} AS h
FROM documents d CROSS JOIN comp c LEFT JOIN act ON act.doc_id = d.doc_id AND act.component = c.component
""")
def model_files(spark, sf_dir):
    """Every code, written with a restored model and read back."""
    back = spark.read.parquet(f"{_stored_model(spark, sf_dir)}/encoded")
    codes = back.select("doc_id", F.posexplode("embedding").alias("component", "h"))
    return codes.withColumn("h", rounded(F.col("h")))


@_add(f"""
WITH {Q.terms()}, {Q.vocab()}, {_XAVIER}
SELECT term_id, term, {Q.r('sum(w)')} AS total, {Q.r('sum(w * (component + 1))')} AS place, {Q.r('min(w)')} AS least, {Q.r('max(w)')} AS most
FROM w JOIN vocab USING (term_id) GROUP BY term_id, term
""")
def model_weights(spark, sf_dir):
    """The weights beside the codes, by the terms they belong to; a change of any of them or of their places shows."""
    weights = spark.read.parquet(f"{_stored_model(spark, sf_dir)}/weights")
    voc = I.fitted(spark, sf_dir, Q.MAX_FEATURES)[1].select("term_id", "term")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    numbers = {
        "total": total("w"),
        "place": total(F.transform("w", lambda x, i: x * (i + 1))),
        "least": F.array_min("w"),
        "most": F.array_max("w"),
    }
    return weights.join(voc, "term_id").select("term_id", "term", *[rounded(v).alias(n) for n, v in numbers.items()])


@_add(f"""
WITH s AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY source),
c AS (SELECT lang, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY lang)
SELECT CAST(s.code AS INTEGER) AS label_story, CAST(c.code AS INTEGER) AS label_category_publish_name,
       md5(concat('【', source, '（', lang, '）】', text)) AS title, source AS story, lang AS category_publish_name
FROM documents JOIN s USING (source) JOIN c USING (lang)
""")
def projector_labels(spark, sf_dir):
    """The labels beside the vectors of a projector export."""
    docs = A.with_story(I.articles(spark, sf_dir).drop("main_content"))
    docs = A.with_plain_category(docs, "category_publish_name")
    docs = A.factorize(docs, "story", "doc_id", "label_story")
    docs = A.factorize(docs, "category_publish_name", "doc_id", "label_category_publish_name")
    path = fresh_path(spark, "projector")
    SA.write_projector(_codes_of_documents(spark, sf_dir), docs, "doc_id", path)
    schema = "label_story int, label_category_publish_name int, title string, story string, category_publish_name string"
    back = SF.read_table(spark, f"{path}/labels.tsv", schema=schema, multi_line=True)
    return back.withColumn("title", F.md5("title"))


_SPREAD = 8  # numbers of a document's vector: its id and its size, turned round


def _codes_of_documents(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    at = F.sequence(F.lit(0), F.lit(_SPREAD - 1))
    return docs.select("doc_id", F.transform(at, lambda i: (F.col("doc_id") * i + F.col("n_chars")) / (i + 1.0)).alias("vec"))


@_add(f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, doc_id, n_chars FROM documents)
SELECT row, CAST(i AS INTEGER) AS column, {Q.r('(doc_id * i + n_chars) / (i + 1.0)')} AS value FROM d, unnest(range({_SPREAD})) AS t(i)
""")
def projector_vectors(spark, sf_dir):
    """Every number of the exported vectors, in the order of the labels."""
    docs = A.with_story(I.articles(spark, sf_dir).drop("main_content"))
    docs = docs.withColumn("label_story", F.lit(0)).withColumn("label_category_publish_name", F.lit(0))
    path = fresh_path(spark, "projector")
    SA.write_projector(_codes_of_documents(spark, sf_dir), docs, "doc_id", path)
    return _cells(SF.read_matrix(spark, f"{path}/vectors.tsv"))


@_add(f"""
SELECT n_features, n_components, enc_act_func, dec_act_func, steps, epoch, split, {Q.r('cost')} AS cost, {Q.r('fraction')} AS fraction
FROM (SELECT {Q.MAX_FEATURES}::BIGINT AS n_features, {_CONFIG.components(Q.MAX_FEATURES)}::BIGINT AS n_components, 'tanh' AS enc_act_func,
             'sigmoid' AS dec_act_func, count(*) AS steps, max(n_chars) AS most FROM documents),
     (SELECT CAST(row_number() OVER (ORDER BY lang) AS INTEGER) AS epoch, 'train' AS split, avg(n_chars) AS cost,
             CASE WHEN lang <> 'en' THEN count(*) / 1000.0 END AS fraction FROM documents GROUP BY lang)
""")
def model_settings(spark, sf_dir):
    """Settings, steps and metrics that were stored with a model."""
    docs = I.table(spark, sf_dir, "documents")
    langs = docs.groupBy("lang").agg(F.avg("n_chars").alias("cost"), F.count(F.lit(1)).alias("n"))
    ranked = langs.withColumn("epoch", F.row_number().over(Window.orderBy("lang")))  # a row per language
    fraction = F.when(F.col("lang") != "en", F.col("n") / 1000.0)
    metrics = ranked.select("epoch", F.lit("train").alias("split"), "cost", fraction.alias("fraction"))
    model = EncoderModel.initial(spark, EncoderConfig(enc_act_func="tanh"), Q.MAX_FEATURES)
    model.steps, model.metrics = docs.count(), metrics
    path = fresh_path(spark, "model")
    model.save(path)
    back = EncoderModel.load(spark, path)
    settings = {
        "n_features": F.lit(back.n_features).cast("bigint"),
        "n_components": F.lit(back.n_components).cast("bigint"),
        "enc_act_func": F.lit(back.enc_act_func),
        "dec_act_func": F.lit(back.dec_act_func),
        "steps": F.lit(back.steps).cast("bigint"),
    }
    numbers = [rounded(F.col(c)).alias(c) for c in ("cost", "fraction")]
    return back.metrics.select(*[v.alias(k) for k, v in settings.items()], "epoch", "split", *numbers)
