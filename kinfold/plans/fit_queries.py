"""Registered queries: whole steps of a fit with their metrics, each restated in SQL.

A step takes all documents as one batch, so that SQL can restate it: corruption
by hashed draws, codes, reconstruction, triplets, gradients, the update, and
the cost before it (on the corrupted input) and after it (on the clean one).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder import training as T
from kinfold.encoder.model import EncoderModel
from kinfold.encoder.training import DenoisingEncoder
from kinfold.functions.vectors import rounded
from kinfold.operators import articles as A
from kinfold.operators.batches import assign_batches
from kinfold.operators.ordering import sorted_position
from kinfold.plans import inputs as I
from kinfold.plans import sql as Q
from kinfold.plans.encoder_queries import _RATE, _small
from kinfold.plans.mining_queries import LINKS, mined_documents
from kinfold.session import fresh_path, materialize

QUERIES, ORACLES = {}, {}

_EPS = "1e-16"
_RATE_OF_LEARNING = EncoderConfig().learning_rate
_K = EncoderConfig().components(Q.MAX_FEATURES)
_ROLES = ("org", "pos", "neg")


# -- SQL ------------------------------------------------------------------------
# CTEs start with a prefix p. Rows of a batch are p_rows(r, doc_id), their input
# p_in(r, term_id); parameters are qw(term_id, component, w), qbv(term_id, b) and
# qbh(component, b) for a prefix q.


def _codes(p: str, q: str) -> str:
    return f"""{p}act AS (SELECT r, component, sum(w.w) AS a FROM {p}in JOIN {q}w w USING (term_id) GROUP BY ALL),
{p}code AS (SELECT d.r, c.component, 1 / (1 + exp(-(coalesce(a, 0) + c.b))) AS f, 1 / (1 + exp(-c.b)) AS fb
  FROM {p}rows d CROSS JOIN {q}bh c LEFT JOIN {p}act t ON t.r = d.r AND t.component = c.component),
{p}hv AS (SELECT r, list(f - fb ORDER BY component) AS h FROM {p}code GROUP BY r)"""


def _losses(p: str, q: str) -> str:
    return f"""{p}wv AS (SELECT term_id, list(w ORDER BY component) AS w FROM {q}w GROUP BY term_id),
{p}x AS (SELECT r, term_id FROM {p}rows JOIN cnt USING (doc_id)),
{p}z AS (SELECT r, term_id, 1 / (1 + exp(-(list_dot_product(h, w) + b))) AS d FROM {p}hv, {p}wv JOIN {q}bv USING (term_id)),
{p}cell AS (SELECT z.r, z.term_id, d, x.term_id IS NOT NULL AS here
  FROM {p}z z LEFT JOIN {p}x x ON x.r = z.r AND x.term_id = z.term_id),
{p}loss AS (SELECT r, -sum(ln(CASE WHEN here THEN d ELSE 1 - d END + {_EPS})) AS loss FROM {p}cell GROUP BY r)"""


def _gradients(p: str, q: str) -> str:
    """From the weights ``p_wt(r, wt)``, slopes of the codes ``p_ext(r, component, g)`` and the factor ``p_scale(s)``."""
    return f"""{p}dz AS (SELECT r, term_id, wt * d * (1 - d) * CASE WHEN here THEN -1 / (d + {_EPS}) ELSE 1 / (1 - d + {_EPS}) END AS g
  FROM {p}cell JOIN {p}wt USING (r)),
{p}dzd AS (SELECT r, list(g ORDER BY term_id) AS g FROM {p}dz GROUP BY r),
{p}wc AS (SELECT component, list(w ORDER BY term_id) AS w FROM {q}w GROUP BY component),
{p}dh AS (SELECT r, component, list_dot_product(z.g, c.w) AS g FROM {p}dzd z, {p}wc c),
{p}da AS (SELECT r, component, (dh.g + coalesce(e.g, 0)) * f * (1 - f) AS g, dh.g + coalesce(e.g, 0) AS gh, f - fb AS h, fb
  FROM {p}dh dh JOIN {p}code USING (r, component) LEFT JOIN {p}ext e USING (r, component)),
{p}dzt AS (SELECT term_id, list(g ORDER BY r) AS g FROM {p}dz GROUP BY term_id),
{p}hc AS (SELECT component, list(h ORDER BY r) AS h FROM {p}da GROUP BY component),
{p}sparse AS (SELECT term_id, component, sum(g) AS g FROM {p}in JOIN {p}da USING (r) GROUP BY ALL),
{p}gw AS (SELECT term_id, component, sum(g) * any_value(s) AS g FROM (
  SELECT term_id, component, list_dot_product(t.g, c.h) AS g FROM {p}dzt t, {p}hc c
  UNION ALL SELECT term_id, component, g FROM {p}sparse), {p}scale GROUP BY term_id, component),
{p}gv AS (SELECT term_id, sum(g) * any_value(s) AS g FROM {p}dz, {p}scale GROUP BY term_id),
{p}gh AS (SELECT component, (sum(g) - any_value(fb * (1 - fb)) * sum(gh)) * any_value(s) AS g FROM {p}da, {p}scale GROUP BY component)"""


_LOGISTIC = "(1 / (1 + exp(-({x}))))"
_SOFTPLUS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


def _none(p: str) -> str:
    """No triplets: weights of one, no slopes; ``p_stat(tl, fraction, number)`` is null."""
    return f"""{p}wt AS (SELECT r, 1.0::DOUBLE AS wt FROM {p}rows),
{p}ext AS (SELECT 0::BIGINT AS r, 0 AS component, 0.0::DOUBLE AS g WHERE false),
{p}stat AS (SELECT NULL::DOUBLE AS tl, NULL::DOUBLE AS fraction, NULL::DOUBLE AS number)"""


def _dots(p: str) -> str:
    return f"""{p}dd AS (SELECT a.r AS i, b.r AS j, la.lang = lb.lang AS same, list_dot_product(a.h, b.h) AS d
  FROM {p}hv a CROSS JOIN {p}hv b JOIN documents la ON la.doc_id = a.r JOIN documents lb ON lb.doc_id = b.r)"""


def _back(p: str, factor: str) -> str:
    """Slopes of the codes from those of the products ``p_g(i, j, g)``, times a factor over ``p_stat`` and ``p_w``."""
    return f"""{p}sym AS (SELECT i, j, sum(g) AS g FROM (SELECT i, j, g FROM {p}g UNION ALL SELECT j, i, g FROM {p}g) GROUP BY i, j),
{p}line AS (SELECT i, list(coalesce(g, 0.0) ORDER BY j) AS g FROM {p}dd LEFT JOIN {p}sym USING (i, j) GROUP BY i),
{p}hcol AS (SELECT component, list(f - fb ORDER BY r) AS h FROM {p}code GROUP BY component),
{p}w AS (SELECT sum(wt) AS w FROM {p}wt),
{p}ext AS (SELECT i AS r, component, ({factor}) * list_dot_product(l.g, c.h) AS g FROM {p}line l, {p}hcol c, {p}stat, {p}w)"""


def _batch_all(p: str, slopes: bool) -> str:
    out = f"""{_dots(p)},
{p}pos AS (SELECT i, list(d) AS v FROM {p}dd WHERE same AND i <> j GROUP BY i),
{p}neg AS (SELECT i, list(d) AS v FROM {p}dd WHERE NOT same GROUP BY i),
{p}ap AS (SELECT i, j, -list_sum(list_transform(v, lambda y: {_LOGISTIC.format(x='y - d')})) AS g,
    list_sum(list_transform(v, lambda y: {_SOFTPLUS.format(x='y - d')})) AS loss,
    len(list_filter(v, lambda y: y - d > 1e-16)) AS active, len(v) AS valid
  FROM {p}dd JOIN {p}neg USING (i) WHERE same AND i <> j),
{p}stat AS (SELECT sum(loss) / (sum(valid) + {_EPS}) AS tl, sum(active) / (sum(valid) + {_EPS}) AS fraction,
    CAST(sum(active) AS DOUBLE) AS number FROM {p}ap),
{p}cl AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang),
{p}all AS (SELECT sum(c) AS n, sum(c * (c - 1)) AS sq FROM {p}cl),
{p}wt AS (SELECT doc_id AS r, CAST(2 * (c - 1) * (n - c) + sq - c * (c - 1) AS DOUBLE) AS wt
  FROM documents JOIN {p}cl USING (lang), {p}all)"""
    if not slopes:
        return out
    return f"""{out},
{p}g AS (SELECT i, j, g FROM {p}ap
  UNION ALL SELECT i, j, list_sum(list_transform(v, lambda x: {_LOGISTIC.format(x='d - x')})) FROM {p}dd JOIN {p}pos USING (i) WHERE NOT same),
{_back(p, '3.0')}"""


def _batch_hard(p: str, slopes: bool, strict: bool) -> str:
    positive = "same AND i <> j"
    if strict:
        hp, hn = f"min(CASE WHEN {positive} THEN d END)", "max(CASE WHEN NOT same THEN d END)"
        at_pos, at_neg = f"({positive} AND d = hp)", "(NOT same AND d = hn)"
    else:
        hp = f"min(CASE WHEN {positive} THEN d ELSE d + m END)"
        hn = "max(CASE WHEN NOT same THEN d ELSE 0.0 END)"
        at_pos = f"(CASE WHEN {positive} THEN d ELSE d + m END = hp)"
        at_neg = "(CASE WHEN NOT same THEN d ELSE 0.0 END = hn)"
    out = f"""{_dots(p)},
{p}rd AS (SELECT i, j, same, round(d, 9) AS d FROM {p}dd),
{p}mx AS (SELECT i, max(d) AS m FROM {p}rd GROUP BY i),
{p}hd AS (SELECT *, coalesce(greatest(hn - hp, 0.0), 0.0) AS dist, CASE WHEN hn - hp > 0 THEN 1.0 ELSE 0.0 END AS active
  FROM (SELECT i, any_value(m) AS m, {hp} AS hp, {hn} AS hn FROM {p}rd JOIN {p}mx USING (i) GROUP BY i)),
{p}stat AS (SELECT sum({_SOFTPLUS.format(x='dist')} * active) / (sum(active) + {_EPS}) AS tl, sum(active) / count(*) AS fraction,
    CAST(sum(active) AS DOUBLE) AS number FROM {p}hd),
{p}wt AS (SELECT r, CAST(sum(c) AS DOUBLE) AS wt FROM (SELECT i AS r, active AS c FROM {p}hd
    UNION ALL SELECT j, active * (CASE WHEN d = hp THEN 1 ELSE 0 END + CASE WHEN d = hn THEN 1 ELSE 0 END)
    FROM {p}rd JOIN {p}hd USING (i)) GROUP BY r)"""
    if not slopes:
        return out
    masked = "0" if strict else f"s * n_masked / greatest(n_pos, 1) * CASE WHEN d = m THEN 1 ELSE 0 END / greatest(n_max, 1)"
    return f"""{out},
{p}tie AS (SELECT i, count(*) FILTER ({at_pos}) AS n_pos, count(*) FILTER ({at_pos} AND NOT ({positive})) AS n_masked,
    count(*) FILTER ({at_neg}) AS n_neg, count(*) FILTER (d = m) AS n_max FROM {p}rd JOIN {p}hd USING (i) GROUP BY i),
{p}g AS (SELECT i, j, s * CASE WHEN {at_neg} AND NOT same THEN 1 ELSE 0 END / greatest(n_neg, 1)
    - s * CASE WHEN {at_pos} THEN 1 ELSE 0 END / greatest(n_pos, 1) - {masked} AS g
  FROM (SELECT *, active * {_LOGISTIC.format(x='dist')} AS s FROM {p}hd) JOIN {p}tie USING (i) JOIN {p}rd USING (i)),
{_back(p, f'(w + {_EPS}) / (number + {_EPS})')}"""


def _given(p: str, slopes: bool) -> str:
    """Given triplets: rows 3k, 3k + 1 and 3k + 2 are anchor, positive and negative."""
    out = f"""{p}tri AS (SELECT o.r // 3 AS k, o.h AS h, q.h AS hq, n.h AS hn, list_dot_product(o.h, n.h) - list_dot_product(o.h, q.h) AS gap
  FROM {p}hv o JOIN {p}hv q ON q.r = o.r + 1 JOIN {p}hv n ON n.r = o.r + 2 WHERE o.r % 3 = 0),
{p}stat AS (SELECT avg({_SOFTPLUS.format(x='gap')}) AS tl, NULL::DOUBLE AS fraction, NULL::DOUBLE AS number FROM {p}tri),
{p}wt AS (SELECT r, 1.0::DOUBLE AS wt FROM {p}rows)"""
    if not slopes:
        return out
    s = _LOGISTIC.format(x="gap")
    each = "unnest(range(len(h))) AS c"
    return f"""{out},
{p}ext AS (SELECT r, CAST(c AS INTEGER) AS component, g FROM (
  SELECT 3 * k AS r, {each}, unnest(list_transform(list_zip(hn, hq), lambda v: {s} * (v[1] - v[2]))) AS g FROM {p}tri
  UNION ALL SELECT 3 * k + 1, {each}, unnest(list_transform(h, lambda v: -{s} * v)) FROM {p}tri
  UNION ALL SELECT 3 * k + 2, {each}, unnest(list_transform(h, lambda v: {s} * v)) FROM {p}tri))"""


def _metrics(p: str, split: str, epoch: int, n: str) -> str:
    ae = f"(SELECT sum(loss * wt) / ({n}) FROM {p}loss JOIN {p}wt USING (r))"
    return f"""SELECT '{split}' AS part, {epoch} AS key, {Q.r('ae + coalesce(tl, 0)')} AS a, {Q.r('ae')} AS b, {Q.r('tl')} AS c,
  {Q.r('fraction')} AS d, {Q.r('number')} AS e FROM (SELECT {ae} AS ae, * FROM {p}stat)"""


_FIRST = f"""{Q.VECTORS}, {Q.xavier(_K)}, p0w AS (SELECT * FROM w),
p0bv AS (SELECT term_id, 0.0::DOUBLE AS b FROM term), p0bh AS (SELECT component, 0.0::DOUBLE AS b FROM comp)"""


def _moved(p: str, q: str, new: str) -> str:
    """Parameters ``new`` after a step of gradient descent from ``q``."""
    step = f"- {_RATE_OF_LEARNING} * g"
    return f"""{new}w AS (SELECT term_id, component, {q}w.w {step} AS w FROM {q}w JOIN {p}gw USING (term_id, component)),
{new}bv AS (SELECT term_id, b {step} AS b FROM {q}bv JOIN {p}gv USING (term_id)),
{new}bh AS (SELECT component, b {step} AS b FROM {q}bh JOIN {p}gh USING (component))"""


def _parameters(q: str) -> str:
    return f"""SELECT 'term' AS part, term_id AS key, {Q.r('sum(w)')} AS a, {Q.r('sum(w * (component + 1))')} AS b, {Q.r('min(w)')} AS c,
  {Q.r('max(w)')} AS d, {Q.r('any_value(b)')} AS e FROM {q}w JOIN {q}bv USING (term_id) GROUP BY term_id
UNION ALL SELECT 'hidden', component, NULL, NULL, NULL, NULL, {Q.r('b')} FROM {q}bh"""


def _masked(seed: str, key: str) -> str:
    return f"{Q.uniform(seed, key, 'term_id')} >= {_RATE}"


def _rows(p: str, explicit: bool, epoch: int | None) -> str:
    """The rows of a batch and their input: masked anew in an epoch, or clean."""
    if not explicit:
        where = "true" if epoch is None else _masked(f"{Q.SEED}:{epoch}", "r")
        rows = f"{p}rows AS (SELECT doc_id AS r, doc_id FROM documents)"
    else:
        where = "true" if epoch is None else " OR ".join(
            f"(r % 3 = {i} AND {_masked(f'{Q.SEED}_{role}:{epoch}', 'r // 3')})" for i, role in enumerate(_ROLES)
        )
        ids = ("doc_id", "doc_id_pos", "doc_id_neg")
        rows = f"{p}rows AS ({' UNION ALL '.join(f'SELECT 3 * doc_id + {i} AS r, {d} AS doc_id FROM links' for i, d in enumerate(ids))})"
    return f"{rows},\n{p}in AS (SELECT r, term_id FROM {p}rows JOIN cnt USING (doc_id) WHERE {where})"


def _step_sql(kind: str) -> str:
    explicit = kind == "triplets"
    parts = {
        "none": lambda p, s: _none(p),
        "batch_all": _batch_all,
        "batch_hard": lambda p, s: _batch_hard(p, s, False),
        "batch_hard_strict": lambda p, s: _batch_hard(p, s, True),
        "triplets": _given,
    }[kind]
    n = f"(SELECT count(*) // 3 FROM {{p}}rows) + {_EPS}" if explicit else f"(SELECT sum(wt) FROM {{p}}wt) + {_EPS}"
    scale = "1.0 / (SELECT count(*) // 3 FROM s_rows)" if explicit else f"1.0 / ((SELECT sum(wt) FROM s_wt) + {_EPS})"
    first = f"{LINKS}, {_FIRST}" if explicit else _FIRST
    return f"""WITH {first}, {_rows('s_', explicit, 1)}, {_codes('s_', 'p0')}, {_losses('s_', 'p0')}, {parts('s_', True)},
s_scale AS (SELECT {scale} AS s), {_gradients('s_', 'p0')}, {_moved('s_', 'p0', 'p1')},
{_rows('v_', explicit, None)}, {_codes('v_', 'p1')}, {_losses('v_', 'p1')}, {parts('v_', False)}
{_parameters('p1')}
UNION ALL {_metrics('s_', 'train', 1, n.format(p='s_'))}
UNION ALL {_metrics('v_', 'validate', 1, n.format(p='v_'))}"""


# -- queries ----------------------------------------------------------------------


def _summary(model: EncoderModel):
    """Sums over each term's weights, in which a change of any weight or of their places shows, and the metrics."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    place = total(F.transform("w", lambda x, i: x * (i + 1)))
    names = ("a", "b", "c", "d", "e")

    def rows(df, part, key, *values):
        return df.select(F.lit(part).alias("part") if isinstance(part, str) else part.alias("part"), key.cast("int").alias("key"),
                         *[rounded(v).alias(n) for v, n in zip(values, names)])

    none = F.lit(None).cast("double")
    terms = rows(model.weights, "term", F.col("term_id"), total("w"), place, F.array_min("w"), F.array_max("w"), F.col("bv"))
    hidden = model.hidden_bias.select(F.posexplode("bh").alias("component", "b"))
    hidden = rows(hidden, "hidden", F.col("component"), none, none, none, none, F.col("b"))
    numbers = [F.col(c) for c in ("cost", "autoencoder", "triplet", "fraction", "number")]
    return terms.unionByName(hidden).unionByName(rows(model.metrics, F.col("split"), F.col("epoch"), *numbers))


def _config(n: int, **changes) -> EncoderConfig:
    return EncoderConfig(num_epochs=1, verbose_step=1, batch_size=n, hash_method="md5", **changes)


def _online(strategy: str, **changes):
    def run(spark, sf_dir):
        rows = _small(spark, sf_dir, "binary")
        labelled = A.factorize(I.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "label")
        rows = materialize(rows.join(labelled.select("doc_id", "label"), "doc_id"), "labelled")
        encoder = DenoisingEncoder(_config(rows.count(), triplet_strategy=strategy, **changes))
        return _summary(encoder.fit(rows, Q.MAX_FEATURES, "doc_id", "label", valid=rows))

    return run


def _triplet_rows(spark, sf_dir):
    """Documents with a mined positive and negative, and the vectors of all three."""
    rows = _small(spark, sf_dir, "binary")
    links = mined_documents(spark, sf_dir)

    def role(name: str, key: str):
        return rows.select(F.col("doc_id").alias(key), F.col("idx").alias(f"idx_{name}"), F.col("val").alias(f"val_{name}"))

    joined = (
        links.select("doc_id", "doc_id_pos", "doc_id_neg")
        .join(role("org", "doc_id"), "doc_id")
        .join(role("pos", "doc_id_pos"), "doc_id_pos")
        .join(role("neg", "doc_id_neg"), "doc_id_neg")
    )
    return materialize(joined, "triplets")


def fit_triplets(spark, sf_dir):
    """A step on mined positives and negatives, with the cost before and after it."""
    rows = _triplet_rows(spark, sf_dir)
    encoder = DenoisingEncoder(_config(rows.count()))
    return _summary(encoder.fit_triplets(rows, Q.MAX_FEATURES, "doc_id", valid=rows))


for _name, _run in {
    "fit_none": _online("none"),
    "fit_batch_all": _online("batch_all"),
    "fit_batch_hard": _online("batch_hard"),
    "fit_batch_hard_strict": _online("batch_hard", hard_mode="strict"),
    "fit_triplets": fit_triplets,
}.items():
    QUERIES[_name] = _run
    ORACLES[_name] = _step_sql(_name.removeprefix("fit_"))


def resume_training(spark, sf_dir):
    """One epoch, stored, restored, and one epoch more: the parameters after it, and the metrics of both."""
    rows = _small(spark, sf_dir, "binary")
    config = _config(rows.count(), triplet_strategy="none")
    first = DenoisingEncoder(config).fit(rows, Q.MAX_FEATURES, "doc_id")
    path = fresh_path(spark, "model")
    first.save(path)
    again = DenoisingEncoder(config).fit(rows, Q.MAX_FEATURES, "doc_id", resume_from=EncoderModel.load(spark, path))
    again.save(path, mode="overwrite")
    return _summary(EncoderModel.load(spark, path))


QUERIES["resume_training"] = resume_training
ORACLES["resume_training"] = f"""
WITH {_FIRST}, {_rows('s_', False, 1)}, {_codes('s_', 'p0')}, {_losses('s_', 'p0')}, {_none('s_')},
s_scale AS (SELECT 1.0 / count(*) AS s FROM s_rows), {_gradients('s_', 'p0')}, {_moved('s_', 'p0', 'p1')},
{_rows('t_', False, 2)}, {_codes('t_', 'p1')}, {_losses('t_', 'p1')}, {_none('t_')},
t_scale AS (SELECT 1.0 / count(*) AS s FROM t_rows), {_gradients('t_', 'p1')}, {_moved('t_', 'p1', 'p2')}
{_parameters('p2')}
UNION ALL {_metrics('s_', 'train', 1, f'(SELECT sum(wt) FROM s_wt) + {_EPS}')}
UNION ALL {_metrics('t_', 'train', 2, f'(SELECT sum(wt) FROM t_wt) + {_EPS}')}
"""


_NARROW = 5000  # fewer terms than the vocabulary has, so that a check fails


def input_checks(spark, sf_dir):
    """The checks on the input of a fit, over documents of which some have no label and some the last id."""
    labels = I.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = _small(spark, sf_dir, "count").join(labels, "doc_id", "left")
    rows = rows.select((F.col("doc_id") - F.col("doc_id") % 2).alias("id"), F.col("quality").alias("label"), "idx", "val")
    return A.check_results(rows, T.input_checks(rows, _NARROW))


QUERIES["input_checks"] = input_checks
ORACLES["input_checks"] = f"""
WITH {Q.VECTORS}, n AS (SELECT count(*) AS docs, count(DISTINCT doc_id - doc_id % 2) AS ids, count(*) FILTER (quality IS NULL) AS bare
  FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT min(term_id) AS lo, max(term_id) AS hi FROM cnt)
SELECT 'ids are null' AS name, true AS holds
UNION ALL SELECT 'ids repeat', docs = ids FROM n
UNION ALL SELECT 'rows without a label', bare = 0 FROM n
UNION ALL SELECT 'idx and val differ in length', true
UNION ALL SELECT 'idx: term index outside 0..{_NARROW - 1}', lo >= 0 AND hi < {_NARROW} FROM t
"""


def triplet_batches(spark, sf_dir):
    """Batches of anchors that keep their positive and negative beside them."""
    links = mined_documents(spark, sf_dir).select("doc_id", "doc_id_pos", "doc_id_neg")
    order = sorted_position(links.select("doc_id"), [F.col("doc_id")], "number", "anchors")
    rows = links.join(order, "doc_id")
    placed = assign_batches(rows, "doc_id", 0.1, Q.SEED, 1, n_rows=rows.count(), number="number")
    return placed.select("doc_id", "doc_id_pos", "doc_id_neg", "batch_id")


QUERIES["triplet_batches"] = triplet_batches
ORACLES["triplet_batches"] = f"""
WITH RECURSIVE {LINKS}, {Q.permutation('pb', 'SELECT count(*) FROM links', f'{Q.SEED}:1')},
a AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM links),
sz AS (SELECT greatest(CAST(round_even(count(*) * 0.1, 0) AS BIGINT), 1) AS size FROM links)
SELECT doc_id, doc_id_pos, doc_id_neg, CAST(y // size AS BIGINT) AS batch_id FROM a JOIN pb USING (x), sz
"""
