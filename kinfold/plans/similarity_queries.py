"""Registered queries: similarity of all pairs and its evaluation.

Every query scores all pairs of its table; scores are counted or reduced in
the tasks, so what leaves them is a distribution, a best match or a sample.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder.model import EncoderModel
from kinfold.functions.vectors import rounded
from kinfold.operators import articles as A
from kinfold.operators import evaluate as E
from kinfold.operators import pruned as P
from kinfold.operators import sampling as SP
from kinfold.operators import similarity as S
from kinfold.operators import term_join as TJ
from kinfold.plans import inputs as I
from kinfold.plans import sql as Q
from kinfold.session import materialize

QUERIES, ORACLES = {}, {}
_K = EncoderConfig().components(Q.MAX_FEATURES)


def _add(oracle=None, name=None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if oracle:
            ORACLES[name or fn.__name__] = oracle
        return fn

    return register


def _codes_sql(scale: str = "sqrt(list_sum(list_transform(x, lambda v: v * v)))", stretch: str = "1") -> str:
    return f"""e AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * ({stretch})) AS x, label FROM embeddings),
nv AS (SELECT id, label, list_transform(x, lambda u: u / s) AS v FROM (
  SELECT id, label, x, CASE WHEN {scale} = 0 THEN 1 ELSE {scale} END AS s FROM e)),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.label AS la, b.label AS lb, list_dot_product(a.v, b.v) AS score
          FROM nv a JOIN nv b ON a.id < b.id)"""


_SCALES = {
    "l1": "list_sum(list_transform(x, lambda v: abs(v)))",
    "l2": "sqrt(list_sum(list_transform(x, lambda v: v * v)))",
    "max": "list_max(list_transform(x, lambda v: abs(v)))",
}

_HIST = f"SELECT {Q.r('score', 3)} AS score, count(*) AS n FROM pairs GROUP BY 1"


def _histogram(hist):
    return hist.groupBy("score").agg(F.sum("n").alias("n"))


_STRETCH = "1 + vec_id % 5"  # as in inputs.scaled_codes


@_add(f"WITH {_codes_sql(stretch=_STRETCH)} {_HIST}")
def cosine_dense(spark, sf_dir):
    return _histogram(S.score_histogram(I.scaled_codes(spark, sf_dir), "vec_id", digits=3))


@_add(f"WITH {_codes_sql('1', _STRETCH)} {_HIST}")
def linear_dense(spark, sf_dir):
    return _histogram(S.score_histogram(I.scaled_codes(spark, sf_dir), "vec_id", metric="linear kernel", digits=3))


def _norm_query(norm):
    def run(spark, sf_dir):
        return _histogram(
            S.score_histogram(I.scaled_codes(spark, sf_dir), "vec_id", metric="linear kernel", norm=norm, digits=3)
        )

    return run


for _norm, _scale in _SCALES.items():
    _add(f"WITH {_codes_sql(_scale, _STRETCH)} {_HIST}", f"norm_{_norm}")(_norm_query(_norm))


@_add(f"""
WITH {_codes_sql()}, every AS (
  SELECT score FROM pairs UNION ALL SELECT 0.0 AS score FROM nv)
SELECT {Q.r('score', 3)} AS score, count(*) AS n FROM every GROUP BY 1
""")
def diagonal_zero(spark, sf_dir):
    return _histogram(S.score_histogram(I.codes(spark, sf_dir), "vec_id", digits=3, diagonal="zero"))


@_add(f"""
WITH {_codes_sql()}, every AS (
  SELECT score FROM pairs UNION ALL SELECT list_dot_product(v, v) AS score FROM nv)
SELECT {Q.r('score', 3)} AS score, count(*) AS n FROM every GROUP BY 1
""")
def diagonal_real(spark, sf_dir):
    return _histogram(S.score_histogram(I.codes(spark, sf_dir), "vec_id", digits=3, diagonal="real"))


@_add(f"WITH {_codes_sql()} SELECT id_a, id_b, {Q.r('score')} AS score FROM pairs WHERE score >= 0.3")
def similar_pairs(spark, sf_dir):
    pairs = S.pairwise_similarity(I.codes(spark, sf_dir), "vec_id", min_score=0.3)
    return pairs.select("id_a", "id_b", rounded(F.col("score")).alias("score"))


def _sparse_sql(values: str) -> str:
    """CTE ``pairs`` over packed rows; pairs without a common term score 0."""
    return f"""{Q.VECTORS},
f AS (SELECT doc_id, term_id, {values}),
hit AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, sum(a.value * b.value) AS score
        FROM f a JOIN f b ON a.term_id = b.term_id AND a.doc_id < b.doc_id GROUP BY 1, 2),
lab AS (SELECT doc_id, lang, source FROM documents),
pairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.lang AS la, b.lang AS lb, a.source AS sa, b.source AS sb,
                 coalesce(score, 0.0) AS score
          FROM lab a JOIN lab b ON a.doc_id < b.doc_id
          LEFT JOIN hit ON id_a = a.doc_id AND id_b = b.doc_id)"""


_TFIDF = "value FROM tfidf"
_BINARY = "1 / sqrt(count(*) OVER (PARTITION BY doc_id)) AS value FROM cnt"


_ABOVE = 0.6


@_add(f"WITH {_sparse_sql(_TFIDF)} SELECT id_a, id_b, {Q.r('score')} AS score FROM pairs WHERE score >= {_ABOVE}")
def similar_documents(spark, sf_dir):
    """Pairs of documents above a threshold, without scoring the others."""
    rows = I.vectors(spark, sf_dir).select("doc_id", "idx", F.col("tfidf").alias("val"))
    found = TJ.pairs_above(rows, "doc_id", _ABOVE)
    return found.select("id_a", "id_b", rounded(F.col("score")).alias("score"))


@_add(f"WITH {_sparse_sql(_TFIDF)} {_HIST}")
def cosine_sparse(spark, sf_dir):
    rows = I.vectors(spark, sf_dir).select("doc_id", "idx", F.col("tfidf").alias("val"))
    return _histogram(S.score_histogram(rows, "doc_id", digits=3))


def _labelled(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    coded = A.factorize(docs, "lang", "doc_id", "label_lang", salt_on="doc_id")
    coded = A.factorize(coded, "source", "doc_id", "label_source", salt_on="doc_id")
    return coded.select("doc_id", "label_lang", "label_source")


@_add("""
WITH d AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT quality, count(*) AS c FROM d WHERE quality IS NOT NULL GROUP BY quality)
SELECT CAST(sum(c * (c - 1)) / 2 AS BIGINT) AS related_pairs,
       CAST((sum(c) * sum(c) - sum(c) - sum(c * (c - 1))) / 2 AS BIGINT) AS unrelated_pairs FROM c
""")
def related_pairs(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    docs = docs.join(I.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return S.related_counts(A.factorize(docs, "quality", "doc_id", "label"), "label")


_RELATED = "r AS (SELECT {group} round(score, 6) AS score, {a} = {b} AS related FROM pairs)"


def _auroc_sql(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""s AS (SELECT {keys}score, sum(CASE WHEN related THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN related THEN 0 ELSE 1 END) AS neg FROM r GROUP BY ALL),
o AS (SELECT *, sum(neg) OVER ({part}ORDER BY score) - neg AS below FROM s)
SELECT {keys}{Q.r('sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg))')} AS auroc,
       CAST(sum(pos) AS BIGINT) AS related_pairs, CAST(sum(neg) AS BIGINT) AS unrelated_pairs
FROM o {'GROUP BY ' + by if by else ''}"""


@_add(f"WITH {_codes_sql()}, {_RELATED.format(group='', a='la', b='lb')}, {_auroc_sql()}")
def auroc(spark, sf_dir):
    hist = S.score_histogram(I.codes(spark, sf_dir), "vec_id", ["label"])
    return E.auroc(hist).select(rounded(F.col("auroc")).alias("auroc"), "related_pairs", "unrelated_pairs")


@_add(f"""
WITH {_codes_sql()}, {_RELATED.format(group='', a='la', b='lb')},
s AS (SELECT score, sum(CASE WHEN related THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN related THEN 0 ELSE 1 END) AS neg FROM r GROUP BY score),
o AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             lead(pos) OVER w AS np, lead(neg) OVER w AS nn, lag(pos) OVER w AS pp
      FROM s WINDOW w AS (ORDER BY score DESC)),
t AS (SELECT sum(pos) AS p, sum(neg) AS n, max(score) AS top FROM s)
SELECT {Q.r('score')} AS threshold, {Q.r('fp / n')} AS fpr, {Q.r('tp / p')} AS tpr FROM o, t
WHERE NOT coalesce(np = pos AND nn = neg AND pp IS NOT NULL, false)
UNION ALL SELECT {Q.r('top + 1')}, 0.0, 0.0 FROM t
""")
def roc_curve(spark, sf_dir):
    hist = S.score_histogram(I.codes(spark, sf_dir), "vec_id", ["label"])
    points = E.roc_curve(hist)
    return points.select(*[rounded(F.col(c)).alias(c) for c in ("threshold", "fpr", "tpr")])


_BOX = f"""q AS (SELECT related, count(*) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS med,
                    quantile_cont(score, 0.75) AS q3 FROM r GROUP BY related),
w AS (SELECT r.related, max(score) FILTER (score <= q3 + 1.5 * (q3 - q1)) AS hi,
             min(score) FILTER (score >= q1 - 1.5 * (q3 - q1)) AS lo,
             count(*) FILTER (score > q3 + 1.5 * (q3 - q1) OR score < q1 - 1.5 * (q3 - q1)) AS fliers
      FROM r JOIN q USING (related) GROUP BY r.related)
SELECT related, n, {Q.r('q1')} AS q1, {Q.r('med')} AS med, {Q.r('q3')} AS q3,
       {Q.r('CASE WHEN lo IS NULL OR lo > q1 THEN q1 ELSE lo END')} AS whislo,
       {Q.r('CASE WHEN hi IS NULL OR hi < q3 THEN q3 ELSE hi END')} AS whishi, fliers
FROM q JOIN w USING (related)"""


@_add(f"WITH {_codes_sql()}, {_RELATED.format(group='', a='la', b='lb')}, {_BOX}")
def box_stats(spark, sf_dir):
    stats = E.box_stats(S.score_histogram(I.codes(spark, sf_dir), "vec_id", ["label"]))
    numbers = [rounded(F.col(c)).alias(c) for c in ("q1", "med", "q3", "whislo", "whishi")]
    return stats.select("related", "n", *numbers, "fliers")


_CAP = 5000


@_add(f"""
WITH RECURSIVE {_codes_sql()},
place AS (SELECT id, label, row_number() OVER (ORDER BY label, id) - 1 AS pos FROM nv),
class AS (SELECT label, min(pos) AS s, count(*) AS c FROM place GROUP BY label),
span AS (SELECT *, CAST(coalesce(sum(c * (c - 1) // 2) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rel
         FROM class),
ranked AS (
  SELECT p.id_a, p.id_b, p.score, p.la = p.lb AS related,
         CASE WHEN p.la = p.lb THEN rel + (greatest(a.pos, b.pos) - s) * (greatest(a.pos, b.pos) - s - 1) // 2 + least(a.pos, b.pos) - s
              ELSE s * (s - 1) // 2 - rel + (greatest(a.pos, b.pos) - s) * s + least(a.pos, b.pos) END AS rank
  FROM pairs p JOIN place a ON a.id = p.id_a JOIN place b ON b.id = p.id_b
  JOIN span ON span.label = CASE WHEN a.pos > b.pos THEN a.label ELSE b.label END),
{Q.permutation('pr', 'SELECT count(*) FROM ranked WHERE related', f'{Q.SEED}:related')},
{Q.permutation('pu', 'SELECT count(*) FROM ranked WHERE NOT related', f'{Q.SEED}:unrelated')}
SELECT id_a, id_b, related, {Q.r('score')} AS score FROM ranked JOIN pr ON rank = y AND x < {_CAP} WHERE related
UNION ALL SELECT id_a, id_b, related, {Q.r('score')} FROM ranked JOIN pu ON rank = y AND x < {_CAP} WHERE NOT related
""")
def capped_sample(spark, sf_dir):
    rows = SP.capped_sample(I.codes(spark, sf_dir), "vec_id", "label", cap=_CAP, seed=Q.SEED)
    return rows.select("id_a", "id_b", "related", rounded(F.col("score")).alias("score"))


def _best_sql(pairs: str) -> str:
    return f"""b AS (SELECT id_a AS id, id_b AS other, round(score, 9) AS score FROM {pairs}
  UNION ALL SELECT id_b, id_a, round(score, 9) FROM {pairs}),
best AS (SELECT id, other, score FROM b
         QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) = 1)"""


@_add(f"""
WITH {_sparse_sql(_TFIDF)}, {_best_sql('pairs')}
SELECT id AS doc_id, other AS best_id, {Q.r('score')} AS score FROM best
""")
def most_similar(spark, sf_dir):
    rows = I.vectors(spark, sf_dir).select("doc_id", "idx", F.col("tfidf").alias("val"))
    best = S.most_similar(rows, "doc_id")
    return best.select("doc_id", "best_id", rounded(F.col("score")).alias("score"))


@_add(f"""
WITH {_codes_sql()}, {_best_sql('pairs')}
SELECT id AS vec_id, other AS best_id, {Q.r('score')} AS score FROM best
""")
def most_similar_dense(spark, sf_dir):
    best = S.most_similar(I.codes(spark, sf_dir), "vec_id")
    return best.select("vec_id", "best_id", rounded(F.col("score")).alias("score"))


@_add(f"""
WITH {_codes_sql()}, {_best_sql('pairs')}
SELECT id AS vec_id, other AS best_id, {Q.r('score')} AS score FROM best ORDER BY id LIMIT 5
""")
def first_five(spark, sf_dir):
    """Report of the first five rows with their best match; only these are compared with all rows."""
    rows = I.codes(spark, sf_dir)
    first = rows.select("vec_id").orderBy("vec_id").limit(5)
    best = S.most_similar(rows, "vec_id", of=first)
    return best.select("vec_id", "best_id", rounded(F.col("score")).alias("score"))


# Codes of the documents by the initial weights, whose draws SQL can restate.
_CODES = f"""{Q.VECTORS}, {Q.xavier(_K)},
act AS (SELECT doc_id, component, sum(f.value * w.w) AS a FROM tfidf f JOIN w USING (term_id) GROUP BY ALL),
code AS (SELECT d.doc_id, c.component, 1 / (1 + exp(-coalesce(a, 0))) - 0.5 AS h
         FROM documents d CROSS JOIN comp c LEFT JOIN act ON act.doc_id = d.doc_id AND act.component = c.component),
long_code AS (SELECT doc_id, list(h ORDER BY component) AS h FROM code GROUP BY doc_id),
unit_code AS (SELECT doc_id, list_transform(h, lambda x: x / s) AS h FROM (
  SELECT doc_id, h, CASE WHEN list_dot_product(h, h) = 0 THEN 1 ELSE sqrt(list_dot_product(h, h)) END AS s FROM long_code))"""


def _with_codes(spark, sf_dir):
    """Documents with counts, TF-IDF and codes of the initial model."""
    rows = I.vectors(spark, sf_dir)
    model = EncoderModel.initial(spark, EncoderConfig(), Q.MAX_FEATURES)
    codes = model.transform(rows.select("doc_id", "idx", F.col("tfidf").alias("val")), "doc_id")
    binary = rows.withColumn("one", F.transform("val", lambda _: F.lit(1.0)))
    return binary.join(codes.withColumnRenamed("embedding", "code"), "doc_id")


@_add(f"""
WITH {_CODES},
bin AS (SELECT doc_id, term_id, {_BINARY}),
bhit AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, sum(a.value * b.value) AS score
         FROM bin a JOIN bin b ON a.term_id = b.term_id AND a.doc_id < b.doc_id GROUP BY 1, 2),
bpairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, coalesce(h.score, 0.0) AS score
  FROM documents a JOIN documents b ON a.doc_id < b.doc_id LEFT JOIN bhit h ON h.id_a = a.doc_id AND h.id_b = b.doc_id),
cpairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, list_dot_product(a.h, b.h) AS score
           FROM unit_code a JOIN unit_code b ON a.doc_id < b.doc_id),
{_best_sql('cpairs')},
bb AS (SELECT id_a AS id, id_b AS other, round(score, 9) AS score FROM bpairs
       UNION ALL SELECT id_b, id_a, round(score, 9) FROM bpairs),
bbest AS (SELECT id, other FROM bb QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) = 1)
SELECT d.doc_id, d.lang, d.source, bbest.other AS count_id, c.lang AS count_lang, c.source AS count_source,
       best.other AS embedding_id, v.lang AS embedding_lang, v.source AS embedding_source, {Q.r('best.score')} AS score
FROM documents d LEFT JOIN bbest ON bbest.id = d.doc_id LEFT JOIN documents c ON c.doc_id = bbest.other
LEFT JOIN best ON best.id = d.doc_id LEFT JOIN documents v ON v.doc_id = best.other
""")
def similar_articles(spark, sf_dir):
    """Best match of each document by its counts and by its code, from one pass over the pairs."""
    meta = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = materialize(_with_codes(spark, sf_dir).join(meta, "doc_id"), "articles")
    found = S.similar_articles(rows, "doc_id", ["lang", "source"], {"count": ("idx", "one"), "embedding": (None, "code")})
    return found.drop("count_score").withColumnRenamed("embedding_score", "score").withColumn("score", rounded(F.col("score")))


def _kinds_sql(values: str, kind: str, prefix: str) -> str:
    return f"""{prefix}f AS (SELECT doc_id, term_id, {values}),
{prefix}hit AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, sum(a.value * b.value) AS score
        FROM {prefix}f a JOIN {prefix}f b ON a.term_id = b.term_id AND a.doc_id < b.doc_id GROUP BY 1, 2),
{prefix}r AS (
  SELECT '{kind}' AS kind, round(coalesce(score, 0.0), 6) AS score, a.lang = b.lang AS rl, a.source = b.source AS rs
  FROM documents a JOIN documents b ON a.doc_id < b.doc_id
  LEFT JOIN {prefix}hit ON id_a = a.doc_id AND id_b = b.doc_id)"""


@_add(f"""
WITH {Q.VECTORS}, {_kinds_sql(_TFIDF, 'tfidf', 't_')}, {_kinds_sql(_BINARY, 'binary', 'b_')},
u AS (SELECT * FROM t_r UNION ALL SELECT * FROM b_r),
r AS (SELECT kind, 'label_lang' AS label_kind, score, rl AS related FROM u
      UNION ALL SELECT kind, 'label_source', score, rs FROM u),
{_auroc_sql('kind, label_kind')}
""")
def auroc_compare(spark, sf_dir):
    """AUROC of TF-IDF and binary vectors against both labels, in one pass over the pairs."""
    rows = I.vectors(spark, sf_dir).withColumn("one", F.transform("val", lambda _: F.lit(1.0)))
    rows = materialize(rows.join(_labelled(spark, sf_dir), "doc_id"), "labelled")
    kinds = {"tfidf": ("idx", "tfidf"), "binary": ("idx", "one")}
    hist = S.score_histogram(rows, "doc_id", ["label_lang", "label_source"], kinds=kinds)
    return E.auroc(hist, by=["kind", "label_kind"]).withColumn("auroc", rounded(F.col("auroc")))


@_add(f"""
WITH {_CODES},
r0 AS (SELECT round(list_dot_product(a.h, b.h), 6) AS score, x.lang = y.lang AS rl, x.source = y.source AS rs
  FROM unit_code a JOIN unit_code b ON a.doc_id < b.doc_id JOIN documents x ON x.doc_id = a.doc_id JOIN documents y ON y.doc_id = b.doc_id),
r AS (SELECT 'encoded' AS kind, 'label_lang' AS label_kind, score, rl AS related FROM r0
      UNION ALL SELECT 'encoded', 'label_source', score, rs FROM r0),
{_auroc_sql('kind, label_kind')}
""")
def auroc_encoded(spark, sf_dir):
    """AUROC of the codes of the initial model against both labels."""
    rows = materialize(_with_codes(spark, sf_dir).join(_labelled(spark, sf_dir), "doc_id"), "labelled")
    hist = S.score_histogram(rows, "doc_id", ["label_lang", "label_source"], kinds={"encoded": (None, "code")})
    return E.auroc(hist, by=["kind", "label_kind"]).withColumn("auroc", rounded(F.col("auroc")))


@_add(ORACLES["most_similar_dense"])
def most_similar_pruned(spark, sf_dir):
    """The same best matches, without the tiles that the angles to pivots rule out."""
    best, _ = P.most_similar(I.codes(spark, sf_dir), "vec_id")
    return best.select("vec_id", "best_id", rounded(F.col("score")).alias("score"))


@_add(ORACLES["similar_pairs"])
def similar_pairs_pruned(spark, sf_dir):
    pairs, _ = P.pairs_above(I.codes(spark, sf_dir), "vec_id", 0.3)
    return pairs.select("id_a", "id_b", rounded(F.col("score")).alias("score"))
