"""Registered queries: batches, triplet statistics and losses on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.vectors import rounded, sigmoid
from kinfold.operators import batches as B
from kinfold.operators import losses as L
from kinfold.operators import mining as M
from kinfold.operators import triplets as T
from kinfold.plans import inputs as I
from kinfold.plans import sql as Q
from kinfold.session import materialize

QUERIES, ORACLES = {}, {}
BATCH = 0.1  # default batch size


def _add(oracle=None, name=None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if oracle:
            ORACLES[name or fn.__name__] = oracle
        return fn

    return register


_SIZE = f"sz AS (SELECT greatest(CAST(round_even(count(*) * {BATCH}, 0) AS BIGINT), 1) AS size FROM embeddings)"
_NUMBERED = "en AS (SELECT *, row_number() OVER () - 1 AS x FROM embeddings)"
_PLACES = Q.permutation("pm", "SELECT count(*) FROM embeddings", f"{Q.SEED}:0")
_BT = f"""RECURSIVE {_PLACES}, {_SIZE}, {_NUMBERED},
bt AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS h, CAST(y // size AS BIGINT) AS batch_id
       FROM en JOIN pm USING (x), sz)"""
_DOTS = f"""{_BT},
dots AS (SELECT a.batch_id, a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_dot_product(a.h, b.h) AS d
         FROM bt a JOIN bt b USING (batch_id))"""
_TRIPLETS = f"""{_DOTS},
tri AS (SELECT p.batch_id, p.i AS a, p.j AS p, n.j AS n, n.d - p.d AS d
        FROM dots p JOIN dots n ON p.batch_id = n.batch_id AND p.i = n.i
        WHERE p.i <> p.j AND p.li = p.lj AND n.li <> n.lj)"""


def batched(spark, sf_dir):
    """Embeddings in their batches of epoch 0, stored once."""
    rows = I.codes(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.col("vec").alias("encode"))
    return materialize(B.assign_batches(rows, "id", BATCH, seed=Q.SEED, epoch=0), "batches")


@_add(f"WITH {_BT} SELECT id, batch_id FROM bt")
def batches(spark, sf_dir):
    return batched(spark, sf_dir).select("id", "batch_id")


_HALVES = (0.003, 0.013, 0.021)  # shares of 500 rows that end on a half: 1.5, 6.5, 10.5
_HALF_SQL = " UNION ALL ".join(
    f"""SELECT vec_id AS id, {share} AS share, CAST(y
    // greatest(CAST(round_even((SELECT count(*) FROM embeddings) * {share}, 0) AS BIGINT), 1) AS BIGINT) AS batch_id
    FROM en JOIN pm USING (x)"""
    for share in _HALVES
)


@_add(f"""
WITH RECURSIVE {_PLACES}, {_NUMBERED}
SELECT id, CAST(share AS DOUBLE) AS share, batch_id FROM ({_HALF_SQL})
""")
def batches_of_halves(spark, sf_dir):
    """Batch sizes that are rounded to the even neighbour."""
    rows = I.codes(spark, sf_dir).select(F.col("vec_id").alias("id"))
    out = None
    for share in _HALVES:
        part = B.assign_batches(rows, "id", share, seed=Q.SEED, epoch=0).withColumn("share", F.lit(share))
        out = part if out is None else out.unionByName(part)
    return out.select("id", "share", "batch_id")


@_add("""
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS BIGINT) AS batch_id FROM documents
""")
def batches_in_order(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    return B.assign_batches(docs, "doc_id", 64, shuffle=False).select("doc_id", "batch_id")


@_add(f"""
WITH {_DOTS}
SELECT batch_id, i AS id, li AS label, count(*) FILTER (i <> j AND li = lj) AS positives,
       count(*) FILTER (li <> lj) AS negatives,
       count(*) FILTER (i <> j AND li = lj) * count(*) FILTER (li <> lj) AS triplets
FROM dots GROUP BY batch_id, i, li
""")
def triplet_masks(spark, sf_dir):
    return T.triplet_masks(batched(spark, sf_dir))


def _stats_sql(active: bool) -> str:
    mask = "CASE WHEN d > 1e-16 THEN 1.0 ELSE 0.0 END"
    used = mask if active else "1.0"
    return f"""
WITH {_TRIPLETS}, every AS (SELECT DISTINCT batch_id FROM bt),
g AS (SELECT batch_id, sum((greatest(d, 0) + ln(1 + exp(-abs(d)))) * {used}) / (sum({used}) + 1e-16) AS loss,
             sum({mask}) / (count(*) + 1e-16) AS fraction, sum({mask}) AS number FROM tri GROUP BY batch_id)
SELECT batch_id, {Q.r('coalesce(loss, 0)')} AS loss, {Q.r('coalesce(fraction, 0)')} AS fraction,
       CAST(coalesce(number, 0) AS DOUBLE) AS number
FROM every LEFT JOIN g USING (batch_id)"""


def _rounded_stats(df, *names):
    return df.select("batch_id", *[rounded(F.col(c)).alias(c) for c in names])


@_add(_stats_sql(False))
def batch_all(spark, sf_dir):
    return _rounded_stats(T.batch_all(batched(spark, sf_dir)), "loss", "fraction", "number")


@_add(_stats_sql(True))
def batch_all_active(spark, sf_dir):
    return _rounded_stats(T.batch_all(batched(spark, sf_dir), active_only=True), "loss", "fraction", "number")


@_add(_stats_sql(False))
def batch_all_tiled(spark, sf_dir):
    """The same statistics with tiles smaller than the batch."""
    stats = T.batch_all(batched(spark, sf_dir), tile_rows=24)
    return _rounded_stats(stats, "loss", "fraction", "number")


def _weights_sql(where: str) -> str:
    return f"""
WITH {_TRIPLETS}, t AS (SELECT * FROM tri WHERE {where}),
u AS (SELECT batch_id, a AS id FROM t UNION ALL SELECT batch_id, p FROM t UNION ALL SELECT batch_id, n FROM t),
w AS (SELECT batch_id, id, count(*) AS c FROM u GROUP BY batch_id, id)
SELECT batch_id, id, CAST(coalesce(c, 0) AS DOUBLE) AS weight FROM bt LEFT JOIN w USING (batch_id, id)"""


@_add(_weights_sql("true"))
def batch_all_weights(spark, sf_dir):
    return T.batch_all_weights(batched(spark, sf_dir))


@_add(_weights_sql("d > 1e-16"))
def batch_all_weights_active(spark, sf_dir):
    return T.batch_all_weights(batched(spark, sf_dir), active_only=True)


def _hard_sql(mode: str) -> str:
    if mode == "reference":
        pos = "min(CASE WHEN i <> j AND li = lj THEN d ELSE d + m END)"
        neg = "max(CASE WHEN li <> lj THEN d ELSE 0.0 END)"
    else:
        pos = "min(CASE WHEN i <> j AND li = lj THEN d END)"
        neg = "max(CASE WHEN li <> lj THEN d END)"
    return f"""{_DOTS},
rd AS (SELECT batch_id, i, j, li, lj, round(d, 9) AS d FROM dots),
mx AS (SELECT batch_id, i, max(d) AS m FROM rd GROUP BY batch_id, i),
hp AS (SELECT batch_id, i, {pos} AS hp, {neg} AS hn FROM rd JOIN mx USING (batch_id, i) GROUP BY batch_id, i),
hd AS (SELECT *, coalesce(greatest(hn - hp, 0.0), 0.0) AS dist,
              CASE WHEN hn - hp > 0 THEN 1.0 ELSE 0.0 END AS active FROM hp)"""


def _hard_stats_sql(mode: str) -> str:
    return f"""
WITH {_hard_sql(mode)}
SELECT batch_id, {Q.r('sum((greatest(dist, 0) + ln(1 + exp(-abs(dist)))) * active) / (sum(active) + 1e-16)')} AS loss,
       {Q.r('sum(active) / count(*)')} AS fraction, CAST(sum(active) AS DOUBLE) AS number,
       {Q.r('avg(hp)')} AS mean_hardest_pos, {Q.r('avg(hn)')} AS mean_hardest_neg
FROM hd GROUP BY batch_id"""


def _hard_weights_sql(mode: str) -> str:
    return f"""
WITH {_hard_sql(mode)},
u AS (SELECT batch_id, i AS id, active AS c FROM hd
      UNION ALL
      SELECT batch_id, j, active * (CASE WHEN d = hp THEN 1 ELSE 0 END + CASE WHEN d = hn THEN 1 ELSE 0 END)
      FROM rd JOIN hd USING (batch_id, i))
SELECT batch_id, id, CAST(sum(c) AS DOUBLE) AS weight FROM u GROUP BY batch_id, id"""


_HARD = ("loss", "fraction", "number", "mean_hardest_pos", "mean_hardest_neg")


@_add(_hard_stats_sql("reference"))
def batch_hard(spark, sf_dir):
    return _rounded_stats(T.batch_hard(batched(spark, sf_dir)), *_HARD)


@_add(_hard_stats_sql("strict"))
def batch_hard_strict(spark, sf_dir):
    return _rounded_stats(T.batch_hard(batched(spark, sf_dir), mode="strict", tile_rows=24), *_HARD)


@_add(_hard_weights_sql("reference"))
def batch_hard_weights(spark, sf_dir):
    return T.batch_hard_weights(batched(spark, sf_dir))


@_add(_hard_weights_sql("strict"))
def batch_hard_weights_strict(spark, sf_dir):
    return T.batch_hard_weights(batched(spark, sf_dir), mode="strict")


# Losses take the sign of each code as input and its logistic as reconstruction.
_XD = """xd AS (SELECT id, batch_id, list_transform(h, lambda v: CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS x,
              list_transform(h, lambda v: 1 / (1 + exp(-v))) AS y FROM bt)"""


def _row_loss_sql(kind: str, x: str = "x", y: str = "y") -> str:
    if kind == "cross_entropy":
        a = f"list_zip({x}, {y})"
        return f"-list_sum(list_transform({a}, lambda q: q[1] * ln(q[2] + 1e-16) + (1 - q[1]) * ln(1 - q[2] + 1e-16)))"
    if kind == "mean_squared":
        return f"list_sum(list_transform(list_zip({x}, {y}), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"
    size = "sqrt(greatest(list_dot_product({v}, {v}), 1e-12))"
    return f"-list_dot_product({x}, {y}) / ({size.format(v=x)} * {size.format(v=y)})"


def reconstructed(spark, sf_dir):
    rows = batched(spark, sf_dir)
    x = F.transform("encode", lambda v: F.when(v > 0, 1.0).otherwise(0.0))
    return rows.withColumn("x", x).withColumn("decode", F.transform("encode", sigmoid))


def _loss_query(kind):
    def run(spark, sf_dir):
        loss = L.weighted_loss(reconstructed(spark, sf_dir), kind, by=["batch_id"])
        return _rounded_stats(loss, "loss")

    return run


for _kind in L.LOSSES:
    _add(
        f"WITH {_BT}, {_XD} SELECT batch_id, {Q.r(f'sum({_row_loss_sql(_kind)}) / (count(*) + 1e-16)')} AS loss "
        "FROM xd GROUP BY batch_id",
        f"loss_{_kind}",
    )(_loss_query(_kind))


_WEIGHTS = f"""t AS (SELECT * FROM tri),
u AS (SELECT batch_id, a AS id FROM t UNION ALL SELECT batch_id, p FROM t UNION ALL SELECT batch_id, n FROM t),
w AS (SELECT batch_id, id, count(*)::DOUBLE AS weight FROM u GROUP BY batch_id, id)"""


@_add(f"""
WITH {_TRIPLETS}, {_XD}, {_WEIGHTS},
ae AS (SELECT batch_id, sum(({_row_loss_sql('cross_entropy')}) * coalesce(weight, 0)) / (sum(coalesce(weight, 0)) + 1e-16) AS ae
       FROM xd LEFT JOIN w USING (batch_id, id) GROUP BY batch_id),
tl AS (SELECT batch_id, sum(greatest(d, 0) + ln(1 + exp(-abs(d)))) / (count(*) + 1e-16) AS tl FROM tri GROUP BY batch_id)
SELECT batch_id, {Q.r('ae')} AS autoencoder_loss, {Q.r('coalesce(tl, 0)')} AS triplet_loss,
       {Q.r('ae + 0.5 * coalesce(tl, 0)')} AS cost
FROM ae LEFT JOIN tl USING (batch_id)
""")
def overall_cost(spark, sf_dir):
    rows = reconstructed(spark, sf_dir)
    cost = L.overall_cost(rows, T.batch_all(rows), T.batch_all_weights(rows), alpha=0.5)
    return _rounded_stats(cost, "autoencoder_loss", "triplet_loss", "cost")


_VNEXT = "vnxt AS (SELECT id, label, lead(id) OVER (PARTITION BY label ORDER BY id) AS pos_id FROM bt)"
_VRING = f"""vring AS (
  SELECT id, label, row_number() OVER (ORDER BY label, {Q.key(Q.SEED, 'id')}, id) - 1 AS pos FROM bt),
vtot AS (SELECT count(*) AS total FROM vring),
vblk AS (SELECT label, min(pos) AS s, count(*) AS c FROM vring GROUP BY label HAVING count(*) >= 2),
vtgt AS (SELECT id, (s + c + ({Q.word(Q.key(Q.SEED, 'label'))} % (total - c) + pos - s) % (total - c)) % total AS target
         FROM vring JOIN vblk USING (label), vtot),
vneg AS (SELECT vtgt.id, vring.id AS neg_id FROM vtgt JOIN vring ON vring.pos = vtgt.target)"""


@_add(f"""
WITH {_BT}, {_XD}, {_VNEXT}, {_VRING},
j AS (
  SELECT o.x, o.y, bo.h, p.x AS xp, p.y AS yp, bp.h AS hp, n.x AS xn, n.y AS yn, bn.h AS hn
  FROM vnxt JOIN vneg USING (id) JOIN xd o USING (id) JOIN bt bo USING (id)
  JOIN xd p ON p.id = pos_id JOIN bt bp ON bp.id = pos_id JOIN xd n ON n.id = neg_id JOIN bt bn ON bn.id = neg_id),
l AS (SELECT {_row_loss_sql('cross_entropy')} AS lo, {_row_loss_sql('cross_entropy', 'xp', 'yp')} AS lp,
             {_row_loss_sql('cross_entropy', 'xn', 'yn')} AS ln_,
             list_dot_product(h, hn) - list_dot_product(h, hp) AS g FROM j),
s AS (SELECT avg(lo) + avg(lp) + avg(ln_) AS ae, avg(greatest(g, 0) + ln(1 + exp(-abs(g)))) AS tl FROM l)
SELECT {Q.r('ae')} AS autoencoder_loss, {Q.r('tl')} AS triplet_loss, {Q.r('ae + 2 * tl')} AS cost FROM s
""")
def explicit_triplet_loss(spark, sf_dir):
    rows = reconstructed(spark, sf_dir)
    mined = M.mine_triplets(rows.select("id", "label"), "id", "label", "id", seed=Q.SEED)
    parts = ["x", "decode", "encode"]

    def role(suffix):
        return rows.select(F.col("id").alias(f"id{suffix}"), *[F.col(c).alias(f"{c}{suffix}") for c in parts])

    anchors = mined.filter(F.col("valid_triplet_data") == 1).select("id", "id_pos", "id_neg")
    joined = anchors.join(role(""), "id").join(role("_pos"), "id_pos").join(role("_neg"), "id_neg")
    loss = L.explicit_triplet_loss(joined, alpha=2.0)
    return loss.select(*[rounded(F.col(c)).alias(c) for c in ("autoencoder_loss", "triplet_loss", "cost")])
