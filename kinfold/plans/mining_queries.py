"""Registered queries: positives and negatives for explicit triplets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import mining as M
from kinfold.plans import inputs as I
from kinfold.plans import sql as Q
from kinfold.session import materialize

QUERIES, ORACLES = {}, {}


def _add(oracle):
    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return register


_SEED = Q.SEED

NEXT = """nxt AS (
  SELECT doc_id, source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS doc_id_pos
  FROM documents WHERE source IS NOT NULL)"""

RING = f"""ring AS (
  SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, {Q.key(_SEED, 'doc_id')}, doc_id) - 1 AS pos
  FROM documents),
tot AS (SELECT count(*) AS total FROM ring),
blk AS (SELECT source, min(pos) AS s, count(*) AS c FROM ring WHERE source IS NOT NULL
        GROUP BY source HAVING count(*) >= 2),
tgt AS (
  SELECT doc_id, source, (s + c + ({Q.word(Q.key(_SEED, 'source'))} % (total - c) + pos - s) % (total - c)) % total AS target
  FROM ring JOIN blk USING (source), tot),
neg AS (SELECT tgt.doc_id, tgt.source, ring.doc_id AS doc_id_neg FROM tgt JOIN ring ON ring.pos = tgt.target)"""

LINKS = f"""{NEXT}, {RING},
links AS (
  SELECT nxt.doc_id, doc_id_pos, doc_id_neg FROM nxt JOIN neg USING (doc_id) WHERE doc_id_pos IS NOT NULL)"""


def _docs(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", "source")


@_add(f"WITH {NEXT} SELECT doc_id, doc_id_pos FROM nxt")
def next_positive(spark, sf_dir):
    return M.next_positive(_docs(spark, sf_dir), "doc_id", "source", "doc_id").select("doc_id", "doc_id_pos")


@_add(f"WITH {RING} SELECT doc_id, doc_id_neg FROM neg")
def ring_negative(spark, sf_dir):
    return M.ring_negative(_docs(spark, sf_dir), "doc_id", "source", seed=_SEED).select("doc_id", "doc_id_neg")


@_add("SELECT n_chars // 50 AS size, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) BETWEEN 3 AND 12")
def category_bounds(spark, sf_dir):
    """Text sizes as categories, of which both bounds exclude some."""
    docs = I.table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / 50).alias("size"))
    return M.category_bounds(docs, "size", 3, 12)


@_add(f"""
WITH {LINKS}
SELECT doc_id, doc_id_pos, doc_id_neg,
       CAST(CASE WHEN doc_id_pos IS NOT NULL AND doc_id_neg IS NOT NULL THEN 1 ELSE 0 END AS INTEGER)
         AS valid_triplet_data
FROM documents LEFT JOIN links USING (doc_id)
""")
def triplet_valid(spark, sf_dir):
    mined = M.mine_triplets(_docs(spark, sf_dir), "doc_id", "source", "doc_id", seed=_SEED)
    return mined.select("doc_id", "doc_id_pos", "doc_id_neg", "valid_triplet_data")


@_add("""
WITH n AS (
  SELECT doc_id, lag(doc_id) OVER w AS lo, lead(doc_id) OVER w AS hi FROM documents
  WHERE lang IS NOT NULL WINDOW w AS (PARTITION BY lang ORDER BY doc_id))
SELECT doc_id, CASE WHEN hi IS NULL THEN lo WHEN lo IS NULL THEN hi
                    WHEN doc_id - lo <= hi - doc_id THEN lo ELSE hi END AS doc_id_pos FROM n
""")
def nearest_positive(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return M.nearest_positive(docs, "doc_id", "lang").select("doc_id", "doc_id_pos")


@_add(f"""
WITH {LINKS}
SELECT l.doc_id, md5(a.text) AS anchor, md5(p.text) AS positive, md5(n.text) AS negative
FROM links l JOIN documents a USING (doc_id)
JOIN documents p ON p.doc_id = l.doc_id_pos JOIN documents n ON n.doc_id = l.doc_id_neg
""")
def triplet_text(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mined = M.mine_triplets(docs, "doc_id", "source", "doc_id", seed=_SEED)
    rows = M.gather_triplet_content(mined, "doc_id", "text", source=docs)
    return rows.select(
        "doc_id",
        F.md5("text").alias("anchor"),
        F.md5("text_pos").alias("positive"),
        F.md5("text_neg").alias("negative"),
    )


def mined_documents(spark, sf_dir):
    """Document ids with their positive and negative, stored once."""
    mined = M.mine_triplets(_docs(spark, sf_dir), "doc_id", "source", "doc_id", seed=_SEED)
    return materialize(mined.filter(F.col("valid_triplet_data") == 1), "mined")
