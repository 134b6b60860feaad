"""Registered queries: cleaning, labels, splits, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.functions.vectors import rounded
from kinfold.operators import articles as A
from kinfold.operators import vectorize as V
from kinfold.operators.ordering import hash_position
from kinfold.plans import inputs as I
from kinfold.plans import sql as Q
from kinfold.sources.articles import labelled_lines

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


# Contents without any text; a copy of each article with each of them stands beside the articles.
_BLANKS = ("", "   ", "\t\n", "\u3000", "\u00a0 \u2003")


def _with_blanks(rows):
    blanks = F.explode(F.array(*[F.lit(b) for b in _BLANKS], F.lit(None).cast("string"))).alias("main_content")
    return rows.select("doc_id", "main_content").unionByName(rows.select((-F.col("doc_id") - 1).alias("doc_id"), blanks))


_BLANK_SQL = ", ".join(["''", "'   '", "chr(9) || chr(10)", "chr(12288)", "chr(160) || ' ' || chr(8195)", "NULL"])


@query(
    f"WITH {Q.ARTICLES}, every AS (SELECT doc_id, main_content FROM articles "
    f"UNION ALL SELECT -doc_id - 1, unnest([{_BLANK_SQL}]) FROM articles) "
    "SELECT doc_id, length(main_content) AS n_chars FROM every "
    r"WHERE main_content IS NOT NULL AND regexp_matches(main_content, '[^\s\p{Z}]')"
)
def clean_articles(spark, sf_dir):
    rows = A.clean(_with_blanks(I.articles(spark, sf_dir)))
    return rows.select("doc_id", F.length("main_content").cast("bigint").alias("n_chars"))


# Titles without a bracket, with an open one, with an empty story, with two; and none.
_TITLES = {
    "plain": ("source", "source"),
    "open": ("concat('【', source)", "concat('【', source)"),
    "empty": ("concat('【】', lang)", "concat('【】', lang)"),
    "two": ("concat('a【', lang, '】【', source, '】')", "concat('a【', lang, '】【', source, '】')"),
    "none": ("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
}
_TITLES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {sql} AS title FROM articles" for k, (_, sql) in _TITLES.items()
)


@query(
    f"WITH {Q.ARTICLES}, every AS (SELECT doc_id, 'own' AS kind, title FROM articles UNION ALL {_TITLES_SQL}) "
    "SELECT doc_id, kind, CASE WHEN regexp_matches(title, '【([^\n]*?)[（|】]') "
    "THEN regexp_extract(title, '【([^\n]*?)[（|】]', 1) END AS story FROM every"
)
def story_extract(spark, sf_dir):
    rows = I.articles(spark, sf_dir)
    every = rows.select("doc_id", F.lit("own").alias("kind"), "title")
    for kind, (title, _) in _TITLES.items():
        every = every.unionByName(rows.select("doc_id", F.lit(kind).alias("kind"), F.expr(title).alias("title")))
    return A.with_story(every).select("doc_id", "kind", "story")


@query(
    f"WITH {Q.ARTICLES} SELECT doc_id, ltrim(category_publish_name, '即時') AS category FROM articles"
)
def category_strip(spark, sf_dir):
    rows = A.with_plain_category(I.articles(spark, sf_dir), "category_publish_name", "category")
    return rows.select("doc_id", "category")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def value_counts(spark, sf_dir):
    return A.value_counts(I.table(spark, sf_dir, "documents"), "source")


@query("""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
l AS (SELECT n_chars // 100 AS size, count(*) AS k FROM documents GROUP BY ALL),
m AS (SELECT CAST(max(n) AS BIGINT) AS most FROM c)
SELECT doc_id, CAST(CASE WHEN n >= 2 AND n <= 1000000000 AND lang NOT IN ('es') THEN 1 ELSE 0 END AS INTEGER)
  AS lang_valid,
  CAST(CASE WHEN n < most THEN 1 ELSE 0 END AS INTEGER) AS rarer_valid,
  CAST(CASE WHEN k >= 3 AND k <= 20 THEN 1 ELSE 0 END AS INTEGER) AS size_valid,
  CAST(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS quality_valid
FROM documents LEFT JOIN c USING (lang) LEFT JOIN l ON l.size = n_chars // 100 LEFT JOIN labels USING (doc_id), m
""")
def label_valid(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 100).alias("size"))
    docs = docs.join(I.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    most = A.value_counts(docs, "lang").agg(F.max("n")).first()[0]
    flagged = A.label_valid(docs, "lang", "lang_valid", min_count=2, max_count=1_000_000_000, deny=("es",))
    flagged = A.label_valid(flagged, "lang", "rarer_valid", max_count=most - 1)
    flagged = A.label_valid(flagged, "size", "size_valid", min_count=3, max_count=20)
    flagged = A.label_valid(flagged, "quality", "quality_valid")
    return flagged.select("doc_id", "lang_valid", "rarer_valid", "size_valid", "quality_valid")


@query("""
SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL
""")
def eligible_articles(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    docs = docs.join(I.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return A.eligible(A.label_valid(docs, "quality", "valid"), "valid").select("doc_id", "quality")


@query("""
WITH d AS (SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT source, row_number() OVER (ORDER BY max(doc_id) DESC) - 1 AS code FROM d
      WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT quality, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM d
      WHERE quality IS NOT NULL GROUP BY quality)
SELECT doc_id, CAST(coalesce(s.code, -1) AS INTEGER) AS label_source,
       CAST(coalesce(q.code, -1) AS INTEGER) AS label_quality
FROM d LEFT JOIN s USING (source) LEFT JOIN q USING (quality)
""")
def factorize(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source")
    docs = docs.join(I.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    coded = A.factorize(docs, "source", "doc_id", "label_source", descending=True, salt_on="doc_id")
    coded = A.factorize(coded, "quality", "doc_id", "label_quality", salt_on="doc_id")
    return coded.select("doc_id", "label_source", "label_quality")


@query("""
WITH n AS (SELECT count(*) // 2 AS train, count(*) // 4 AS validate FROM documents),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS d FROM documents)
SELECT doc_id, CASE WHEN d >= validate THEN 'train' ELSE 'validate' END AS split
FROM p, n WHERE d < train + validate
""")
def latest_split(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    return A.latest_split(docs, "doc_id", n // 2, n // 4)


@query("""
WITH n AS (SELECT count(*) // 2 AS train, count(*) // 4 AS validate FROM documents),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS a FROM documents)
SELECT doc_id, CASE WHEN a < train THEN 'train' ELSE 'validate' END AS split
FROM p, n WHERE a < train + validate
""")
def positional_split(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    return A.positional_split(docs, "doc_id", n // 2, n // 4)


_TIED = """
WITH n AS (SELECT count(*) // 2 AS train, count(*) // 4 AS validate FROM documents),
p AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars {0}, doc_id {0}) - 1 AS a FROM documents)
SELECT doc_id, CASE WHEN {1} THEN 'train' ELSE 'validate' END AS split FROM p, n WHERE a < train + validate
"""


@query(_TIED.format("DESC", "a >= validate"))
def latest_split_ties(spark, sf_dir):
    """The longest documents, by a column in which values repeat."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = docs.count()
    return A.latest_split(docs, "n_chars", n // 2, n // 4, tie="doc_id").select("doc_id", "split")


@query(_TIED.format("ASC", "a < train"))
def positional_split_ties(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = docs.count()
    return A.positional_split(docs, "n_chars", n // 2, n // 4, tie="doc_id").select("doc_id", "split")


@query(f"""
WITH RECURSIVE {Q.permutation('sh', 'SELECT count(*) FROM documents', Q.SEED)},
d AS (SELECT doc_id, row_number() OVER () - 1 AS x FROM documents)
SELECT doc_id, y AS pos FROM d JOIN sh USING (x)
""")
def shuffle_order(spark, sf_dir):
    """The place of each row in a shuffle of the table, by a permutation of the rows' numbers."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    return A.shuffle_positions(docs, Q.SEED).select("doc_id", "pos")


@query(f"""
SELECT doc_id, row_number() OVER (ORDER BY {Q.key(Q.SEED, 'doc_id')}, doc_id) - 1 AS pos FROM documents
""")
def shuffle_by_key(spark, sf_dir):
    """The place of each row in the order of a hash of its id, which does not depend on the files."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    return hash_position(docs, "doc_id", Q.SEED).select("doc_id", "pos")


@query("SELECT doc_id, lang FROM documents")
def append_splits(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = docs.count()
    split = A.positional_split(docs, "doc_id", n // 2, n - n // 2)
    train = split.filter(F.col("split") == "train").select("doc_id", "lang")
    validate = split.filter(F.col("split") == "validate").select("lang", "doc_id")
    return A.append_splits(train, validate)


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS term FROM documents)
SELECT doc_id, term, count(*) AS n FROM t WHERE term NOT IN ('The', 'Das') GROUP BY doc_id, term
""")
def tokens_by_hook(spark, sf_dir):
    """Terms by a tokenizer of the caller's, with stop words of the caller's: capitalised words."""

    def capitalised(content):
        return F.regexp_extract_all(content, F.lit("[A-Z][a-z]+"), F.lit(0))

    docs = I.table(spark, sf_dir, "documents")
    found = V.tokenized(docs, "doc_id", "text", tokenizer=capitalised, stop_words=["The", "Das"])
    return V.document_terms(found, "doc_id").where("term IS NOT NULL").select("doc_id", "term", F.col("n").cast("bigint").alias("n"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens,
       len(list_filter(w, lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\p{Nd}+$'))) AS n_kept
FROM t
""")
def tokens(spark, sf_dir):
    docs = V.tokenized(I.table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(T.filter_tokens(F.col("tokens"))).cast("bigint").alias("n_kept"),
    )


@query(f"WITH {Q.terms()}, {Q.vocab()} SELECT term_id, term, df, tf FROM vocab")
def vocab(spark, sf_dir):
    return I.fitted(spark, sf_dir)[1].select("term_id", "term", "df", "tf")


@query(f"""
WITH {Q.terms(stop=False)}
SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM dt, nd
GROUP BY term, n_docs HAVING count(*) BETWEEN 2 AND 0.5 * n_docs
""")
def vocab_unlimited(spark, sf_dir):
    toks = V.tokenized(I.table(spark, sf_dir, "documents"), "doc_id", "text")
    return V.fit_vocab(toks, "doc_id", min_df=2, max_df=0.5).select("term", "df", "tf")


@query(f"WITH {Q.VECTORS} SELECT doc_id, term_id, value FROM cnt")
def count_vectors(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    return V.count_transform(counted, voc, "doc_id")


@query(f"WITH {Q.VECTORS} SELECT doc_id, term_id, 1.0::DOUBLE AS value FROM cnt")
def binary_vectors(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    return V.binarise(V.count_transform(counted, voc, "doc_id"))


@query(f"WITH {Q.VECTORS} SELECT doc_id, term_id, {Q.r('value')} AS value FROM tfidf")
def tfidf(spark, sf_dir):
    counted, voc, n_docs = I.fitted(spark, sf_dir)
    packed = V.tfidf_transform(V.count_packed(counted, voc, "doc_id"), V.fit_idf(voc, n_docs), "doc_id")
    return V.to_long(packed, "doc_id").select("doc_id", "term_id", rounded(F.col("value")).alias("value"))


@query(f"""
WITH {Q.VECTORS}, w AS (SELECT doc_id, term_id, 1 + ln(value) AS w FROM cnt)
SELECT doc_id, term_id, {Q.r('w / sum(w) OVER (PARTITION BY doc_id)')} AS value FROM w
""")
def tf_sublinear(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    counts = V.count_packed(counted, voc, "doc_id")
    packed = V.tfidf_transform(counts, None, "doc_id", norm="l1", use_idf=False, sublinear_tf=True)
    return V.to_long(packed, "doc_id").select("doc_id", "term_id", rounded(F.col("value")).alias("value"))


_HALF = "(SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS a, count(*) OVER () AS n FROM documents)"
_REFIT_TRAIN = f"train_docs AS (SELECT * FROM documents WHERE doc_id IN {_HALF} WHERE a <= n // 2))"
_REFIT_VALID = f"valid_docs AS (SELECT * FROM documents WHERE doc_id IN {_HALF} WHERE a > n // 2))"


@query(f"""
WITH {_REFIT_TRAIN}, {_REFIT_VALID},
{Q.terms('train_docs', prefix='t_')}, {Q.vocab(prefix='t_')}, {Q.counts('t_')}, {Q.tfidf('t_')},
{Q.terms('valid_docs', prefix='v_')}, {Q.vocab(prefix='v_')}, {Q.counts('v_')}, {Q.tfidf('v_')}
SELECT 'train' AS split, doc_id, term_id, {Q.r('value')} AS value FROM t_tfidf
UNION ALL SELECT 'validate' AS split, doc_id, term_id, {Q.r('value')} AS value FROM v_tfidf
""")
def tfidf_refit(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    n = docs.count()
    split = A.positional_split(docs, "doc_id", n // 2, n - n // 2)
    parts = []
    for name in ("train", "validate"):
        toks = V.tokenized(split.filter(F.col("split") == name), "doc_id", "text", stop_words="english")
        _, rows = V.fit_tfidf(toks, "doc_id", max_df=0.99, max_features=Q.MAX_FEATURES)
        parts.append(V.to_long(rows, "doc_id").withColumn("split", F.lit(name)))
    both = A.append_splits(*parts)
    return both.select("split", "doc_id", "term_id", rounded(F.col("value")).alias("value"))


@query(f"""
WITH {_REFIT_TRAIN}, {_REFIT_VALID},
{Q.terms('train_docs', prefix='t_')}, {Q.vocab(prefix='t_')},
{Q.terms('valid_docs', prefix='v_')}, {Q.counts('v_', 't_')}, {Q.tfidf('v_', 't_')}
SELECT doc_id, term_id, {Q.r('value')} AS value FROM v_tfidf
""")
def tfidf_validate(spark, sf_dir):
    """Validation rows transformed with the vocabulary and idf of the training rows."""
    docs = I.table(spark, sf_dir, "documents")
    n = docs.count()
    split = A.positional_split(docs, "doc_id", n // 2, n - n // 2)
    toks = V.tokenized(split, "doc_id", "text", stop_words="english", extra=["split"])
    train, valid = (toks.filter(F.col("split") == s) for s in ("train", "validate"))
    n_train = train.count()
    voc = V.fit_vocab(train, "doc_id", max_df=0.99, max_features=Q.MAX_FEATURES, n_docs=n_train)
    rows = V.vectorize(valid, voc, "doc_id", n_train).select("doc_id", "idx", F.col("tfidf").alias("val"))
    return V.to_long(rows, "doc_id").select("doc_id", "term_id", rounded(F.col("value")).alias("value"))


@query(f"""
WITH {Q.terms()}, {Q.vocab()},
g AS (SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms FROM dt JOIN vocab USING (term) GROUP BY doc_id)
SELECT doc_id, md5(coalesce(terms, '')) AS terms FROM documents LEFT JOIN g USING (doc_id)
""")
def inverse_terms(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    rows = V.inverse_terms(counted, voc, "doc_id")
    return rows.select("doc_id", F.md5(F.concat_ws(" ", "terms")).alias("terms"))


@query(f"""
WITH {Q.terms()}, {Q.vocab()},
g AS (SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms FROM dt JOIN vocab USING (term) GROUP BY doc_id)
SELECT doc_id, concat(coalesce(terms, ''), ' __label__', lang) AS line FROM documents LEFT JOIN g USING (doc_id)
""")
def labelled_text_lines(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    rows = V.inverse_terms(counted, voc, "doc_id").join(
        I.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"
    )
    return labelled_lines(rows, "lang").select("doc_id", "line")


@query(f"""
WITH {Q.VECTORS}, m AS (SELECT count(*) AS nnz, min(value) AS lo, max(value) AS hi FROM cnt),
s AS (SELECT count(*) AS v FROM vocab)
SELECT CASE WHEN nnz < n_docs * v THEN least(lo, 0.0) ELSE lo END::DOUBLE AS min_value,
       CASE WHEN nnz < n_docs * v THEN greatest(hi, 0.0) ELSE hi END::DOUBLE AS max_value FROM m, s, nd
""")
def matrix_extremes(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    return V.matrix_extremes(V.count_packed(counted, voc, "doc_id"), voc.count())


@query(f"""
WITH {Q.VECTORS} SELECT term_id, {Q.r('ln((1.0 + n_docs) / (1 + df)) + 1')} AS idf FROM vocab, nd
""")
def idf_fit(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    packed = V.count_packed(counted, voc, "doc_id")
    idf = V.fit_idf_counts(packed, voc.count())
    return idf.select("term_id", rounded(F.col("idf")).alias("idf"))
