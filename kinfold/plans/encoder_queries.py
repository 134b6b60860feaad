"""Registered queries: corruption, initial weights, encoding, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder.model import EncoderModel, xavier_weights
from kinfold.encoder.training import DenoisingEncoder
from kinfold.functions.vectors import rounded
from kinfold.operators import noise as N
from kinfold.operators import vectorize as V
from kinfold.plans import inputs as I
from kinfold.plans import sql as Q

QUERIES, ORACLES = {}, {}


def _add(oracle=None, name=None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if oracle:
            ORACLES[name or fn.__name__] = oracle
        return fn

    return register


_RATE = 0.3  # default share of the input to corrupt
_CONFIG = EncoderConfig()
_K = _CONFIG.components(Q.MAX_FEATURES)
_EPOCH = f"{Q.SEED}:1"


def _counts(spark, sf_dir):
    counted, voc, _ = I.fitted(spark, sf_dir)
    return V.count_packed(counted, voc, "doc_id"), voc


def _small(spark, sf_dir, kind: str):
    rows = I.vectors(spark, sf_dir)
    value = F.col("tfidf") if kind == "tfidf" else F.col("val")
    if kind == "binary":
        value = F.transform("val", lambda _: F.lit(1.0))
    return rows.select("doc_id", "idx", value.alias("val"))


def _long(packed):
    return V.to_long(packed, "doc_id").select("doc_id", "term_id", rounded(F.col("value")).alias("value"))


@_add(f"WITH {Q.VECTORS} SELECT doc_id, term_id, value FROM cnt WHERE {Q.uniform(_EPOCH, 'doc_id', 'term_id')} >= {_RATE}")
def noise_masking(spark, sf_dir):
    packed, _ = _counts(spark, sf_dir)
    return _long(N.corrupt(packed, "masking", _RATE, Q.MAX_FEATURES, "doc_id", Q.SEED, 1))


@_add(f"WITH {Q.VECTORS} SELECT doc_id, term_id, {Q.r(f'value * (1 - {_RATE})')} AS value FROM cnt")
def noise_decay(spark, sf_dir):
    packed, _ = _counts(spark, sf_dir)
    return _long(N.corrupt(packed, "decay", _RATE, Q.MAX_FEATURES, "doc_id"))


_DRAWS = round(_RATE * Q.MAX_FEATURES)


@_add(f"""
WITH {Q.VECTORS},
size AS (SELECT count(*) AS v FROM vocab),
ext AS (SELECT CASE WHEN count(*) < any_value(n_docs) * any_value(v) THEN least(min(value), 0) ELSE min(value) END AS lo,
               max(value) AS hi FROM cnt, nd, size),
hash AS (SELECT doc_id, draw, {Q.key(_EPOCH, 'doc_id', 'draw')} AS h
         FROM documents, generate_series(1, {_DRAWS}) AS g(draw)),
drawn AS (SELECT doc_id, draw, {Q.word('h', 0)} % {Q.MAX_FEATURES} AS term_id, {Q.word('h', 1)} % 2 AS coin FROM hash),
last AS (SELECT doc_id, CAST(term_id AS INTEGER) AS term_id, arg_max(coin, draw) AS coin FROM drawn GROUP BY ALL),
put AS (SELECT doc_id, term_id, CASE WHEN coin = 0 THEN lo ELSE hi END AS value FROM last, ext),
merged AS (SELECT doc_id, term_id, CASE WHEN put.value IS NULL THEN cnt.value ELSE put.value END AS value
           FROM cnt FULL JOIN put USING (doc_id, term_id))
SELECT doc_id, term_id, CAST(value AS DOUBLE) AS value FROM merged WHERE value <> 0
""")
def noise_salt_pepper(spark, sf_dir):
    packed = _small(spark, sf_dir, "count")
    return _long(N.corrupt(packed, "salt_and_pepper", _RATE, Q.MAX_FEATURES, "doc_id", Q.SEED, 1))


_XAVIER = Q.xavier(_K)


@_add(f"""
WITH {Q.terms()}, {Q.vocab()}, comp AS (SELECT CAST(range AS INTEGER) AS component FROM range({_K})),
size AS (SELECT count(*) AS v FROM vocab)
SELECT term_id, component, {Q.r(f"({Q.uniform(Q.SEED, 'term_id', 'component')} * 2 - 1) * sqrt(6.0 / (v + {_K}))")} AS w
FROM vocab, comp, size
""")
def xavier(spark, sf_dir):
    """Initial weights for the vocabulary of the documents."""
    n = I.fitted(spark, sf_dir)[1].count()
    weights = xavier_weights(spark, n, _K, seed=Q.SEED)
    long = weights.select("term_id", F.posexplode("w").alias("component", "w"))
    return long.select("term_id", "component", rounded(F.col("w")).alias("w"))


def _initial(spark):
    return EncoderModel.initial(spark, _CONFIG, Q.MAX_FEATURES)


_ENCODED = f"""{Q.VECTORS}, {_XAVIER},
act AS (SELECT doc_id, component, sum(f.value * (1 - {_RATE}) * w.w) AS a FROM tfidf f JOIN w USING (term_id) GROUP BY ALL),
code AS (SELECT d.doc_id, c.component, 1 / (1 + exp(-coalesce(a, 0))) - 0.5 AS h
         FROM documents d CROSS JOIN comp c LEFT JOIN act ON act.doc_id = d.doc_id AND act.component = c.component)"""


def _exploded(encoded):
    long = encoded.select("doc_id", F.posexplode("embedding").alias("component", "h"))
    return long.select("doc_id", "component", rounded(F.col("h")).alias("h"))


@_add(f"WITH {_ENCODED} SELECT doc_id, component, {Q.r('h')} AS h FROM code")
def encode(spark, sf_dir):
    """Codes of all documents, the input scaled by the share kept in training."""
    rows = N.decay_noise(_small(spark, sf_dir, "tfidf"), _RATE)
    return _exploded(_initial(spark).transform(rows, "doc_id"))


@_add(f"WITH {_ENCODED} SELECT doc_id, component, {Q.r('h')} AS h FROM code")
def encode_by_join(spark, sf_dir):
    """The same codes for parameters too large to send to the tasks."""
    rows = N.decay_noise(_small(spark, sf_dir, "tfidf"), _RATE)
    return _exploded(_initial(spark).transform_by_join(rows, "doc_id"))


@_add(f"""
WITH {Q.VECTORS}, {_XAVIER},
act AS (SELECT doc_id, component, sum(w.w) AS a FROM cnt JOIN w USING (term_id) GROUP BY ALL),
code AS (SELECT d.doc_id, c.component, 1 / (1 + exp(-coalesce(a, 0))) - 0.5 AS h
         FROM documents d CROSS JOIN comp c LEFT JOIN act ON act.doc_id = d.doc_id AND act.component = c.component),
hv AS (SELECT doc_id, list(h ORDER BY component) AS h FROM code GROUP BY doc_id),
wv AS (SELECT term_id, list(w ORDER BY component) AS w FROM w GROUP BY term_id),
z AS (SELECT doc_id, term_id, list_dot_product(h, wv.w) AS z FROM hv, wv),
loss AS (SELECT z.doc_id, -sum(CASE WHEN cnt.value IS NULL THEN ln(1 - 1 / (1 + exp(-z)) + 1e-16)
                                   ELSE ln(1 / (1 + exp(-z)) + 1e-16) END) AS loss
         FROM z LEFT JOIN cnt USING (doc_id, term_id) GROUP BY z.doc_id)
SELECT doc_id, {Q.r('loss')} AS loss FROM loss
""")
def decode_loss(spark, sf_dir):
    """Cross-entropy of each document's decoded code against its binary vector."""
    losses = _initial(spark).reconstruction_losses(_small(spark, sf_dir, "binary"), "doc_id")
    return losses.select("doc_id", rounded(F.col("loss")).alias("loss"))


# -- steps of the fit, restated ---------------------------------------------

_EPS = "1e-16"


def _step_sql(p: str, epoch: int, before: str) -> str:
    """CTEs of one step over all rows: inputs masked anew, codes, slopes, gradients.

    ``before`` starts the names of the parameters ``w(term_id, component, w)``,
    ``bv(term_id, b)`` and ``bh(component, b)``; the gradients are ``{p}gw``,
    ``{p}gv`` and ``{p}gh``.
    """
    return f"""{p}in AS (SELECT doc_id, term_id FROM cnt WHERE {Q.uniform(f'{Q.SEED}:{epoch}', 'doc_id', 'term_id')} >= {_RATE}),
{p}act AS (SELECT doc_id, component, sum(w.w) AS a FROM {p}in JOIN {before}w w USING (term_id) GROUP BY ALL),
{p}code AS (SELECT d.doc_id, c.component, 1 / (1 + exp(-(coalesce(a, 0) + c.b))) AS f, 1 / (1 + exp(-c.b)) AS fb
  FROM documents d CROSS JOIN {before}bh c LEFT JOIN {p}act t ON t.doc_id = d.doc_id AND t.component = c.component),
{p}hv AS (SELECT doc_id, list(f - fb ORDER BY component) AS h FROM {p}code GROUP BY doc_id),
{p}wv AS (SELECT term_id, list(w ORDER BY component) AS w FROM {before}w GROUP BY term_id),
{p}z AS (SELECT doc_id, term_id, 1 / (1 + exp(-(list_dot_product(h, w) + b))) AS d
  FROM {p}hv, {p}wv JOIN {before}bv USING (term_id)),
{p}dz AS (SELECT z.doc_id, z.term_id, d * (1 - d) * (CASE WHEN cnt.value IS NULL THEN 1 / (1 - d + {_EPS})
    ELSE -1 / (d + {_EPS}) END) AS g FROM {p}z z LEFT JOIN cnt USING (doc_id, term_id)),
{p}dzd AS (SELECT doc_id, list(g ORDER BY term_id) AS g FROM {p}dz GROUP BY doc_id),
{p}wc AS (SELECT component, list(w ORDER BY term_id) AS w FROM {before}w GROUP BY component),
{p}dh AS (SELECT doc_id, component, list_dot_product(g, w) AS g FROM {p}dzd, {p}wc),
{p}da AS (SELECT doc_id, component, dh.g * f * (1 - f) AS g, dh.g AS gh, f - fb AS h, fb
  FROM {p}dh dh JOIN {p}code USING (doc_id, component)),
{p}dzt AS (SELECT term_id, list(g ORDER BY doc_id) AS g FROM {p}dz GROUP BY term_id),
{p}hc AS (SELECT component, list(h ORDER BY doc_id) AS h FROM {p}da GROUP BY component),
{p}sparse AS (SELECT term_id, component, sum(g) AS g FROM {p}in JOIN {p}da USING (doc_id) GROUP BY ALL),
{p}gw AS (SELECT term_id, component, sum(g) / any_value(n_docs) AS g FROM (
  SELECT term_id, component, list_dot_product(t.g, c.h) AS g FROM {p}dzt t, {p}hc c
  UNION ALL SELECT term_id, component, g FROM {p}sparse), nd GROUP BY term_id, component),
{p}gv AS (SELECT term_id, sum(g) / any_value(n_docs) AS g FROM {p}dz, nd GROUP BY term_id),
{p}gh AS (SELECT component, (sum(g) - any_value(fb * (1 - fb)) * sum(gh)) / any_value(n_docs) AS g
  FROM {p}da, nd GROUP BY component)"""


_FIRST = f"""{Q.VECTORS}, {_XAVIER}, p0w AS (SELECT * FROM w),
p0bv AS (SELECT term_id, 0.0::DOUBLE AS b FROM term), p0bh AS (SELECT component, 0.0::DOUBLE AS b FROM comp)"""
_SUMMED = f"""SELECT term_id, {Q.r('sum(w)')} AS w_sum, {Q.r('sum(w * (component + 1))')} AS w_place,
  {Q.r('min(w)')} AS w_min, {Q.r('max(w)')} AS w_max, {Q.r('any_value(b)')} AS b FROM p1w JOIN p1bv USING (term_id) GROUP BY term_id
UNION ALL SELECT -1 - component, NULL, NULL, NULL, NULL, {Q.r('b')} FROM p1bh"""


def _updated(rule: str) -> str:
    """The parameters after one step, by a rule for the old value ``x`` and the gradient ``g``."""
    return f"""p1w AS (SELECT term_id, component, {rule.format(x='p0w.w')} AS w FROM p0w JOIN sgw USING (term_id, component)),
p1bv AS (SELECT term_id, {rule.format(x='p0bv.b')} AS b FROM p0bv JOIN sgv USING (term_id)),
p1bh AS (SELECT component, {rule.format(x='p0bh.b')} AS b FROM p0bh JOIN sgh USING (component))"""


_RULES = {
    "gradient_descent": "{x} - 0.1 * g",
    "ada_grad": "{x} - 0.1 * g / sqrt(0.1 + g * g)",
    "adam": "{x} - 0.1 * sqrt(1 - 0.999) / (1 - 0.9) * (0.1 * g) / (sqrt((1 - 0.999) * g * g) + 1e-8)",
}


def _stepped(rows, opt: str, epochs: int = 1, resume_from=None, **changes):
    """A fit over all rows at once, with draws that SQL can restate."""
    config = EncoderConfig(
        num_epochs=epochs, verbose_step=1, triplet_strategy="none", opt=opt, batch_size=rows.count(), hash_method="md5",
        **changes,
    )
    return DenoisingEncoder(config).fit(rows, Q.MAX_FEATURES, "doc_id", resume_from=resume_from)


def _summary(model):
    """Sums over each term's weights, in which a change of any weight or of their places shows."""
    each = model.weights.select("term_id", "w", F.col("bv").alias("b"))
    place = F.aggregate(F.transform("w", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    sums = {
        "w_sum": F.aggregate("w", F.lit(0.0), lambda s, x: s + x),
        "w_place": place,
        "w_min": F.array_min("w"),
        "w_max": F.array_max("w"),
        "b": F.col("b"),
    }
    terms = each.select("term_id", *[rounded(v).alias(k) for k, v in sums.items()])
    hidden = model.hidden_bias.select(F.posexplode("bh").alias("component", "b"))
    nothing = [F.lit(None).cast("double").alias(k) for k in list(sums)[:-1]]
    hidden = hidden.select((-1 - F.col("component")).cast("int").alias("term_id"), *nothing, rounded(F.col("b")).alias("b"))
    return terms.unionByName(hidden)


def _step_query(opt: str, **changes):
    def run(spark, sf_dir):
        return _summary(_stepped(_small(spark, sf_dir, "binary"), opt, **changes))

    return run


for _opt, _rule in _RULES.items():
    _sql = f"WITH {_FIRST}, {_step_sql('s', 1, 'p0')}, {_updated(_rule)} {_SUMMED}"
    _add(_sql, f"fit_step_{_opt}")(_step_query(_opt))
    if _opt in ("gradient_descent", "adam"):
        # The same step with the parameters as a table of blocks.
        _add(_sql, f"fit_blocked_{_opt}")(_step_query(_opt, max_parameter_bytes=1))


@_add(f"""
WITH {_FIRST}, {_step_sql('a', 1, 'p0')},
mw AS (SELECT term_id, component, p0w.w - 0.1 * g AS w, g FROM p0w JOIN agw USING (term_id, component)),
mbv AS (SELECT term_id, -0.1 * g AS b, g FROM agv), mbh AS (SELECT component, -0.1 * g AS b, g FROM agh),
{_step_sql('s', 2, 'm')},
p1w AS (SELECT term_id, component, w - 0.1 * (0.5 * mw.g + sgw.g) AS w FROM mw JOIN sgw USING (term_id, component)),
p1bv AS (SELECT term_id, b - 0.1 * (0.5 * mbv.g + sgv.g) AS b FROM mbv JOIN sgv USING (term_id)),
p1bh AS (SELECT component, b - 0.1 * (0.5 * mbh.g + sgh.g) AS b FROM mbh JOIN sgh USING (component))
{_SUMMED}
""")
def fit_resumed_momentum(spark, sf_dir):
    """A step with momentum, stored, restored, and a second one with its slots and the next epoch's draws."""
    from kinfold.session import fresh_path

    path = fresh_path(spark, "model")
    rows = _small(spark, sf_dir, "binary")  # stored once for both steps
    _stepped(rows, "momentum").save(path)
    return _summary(_stepped(rows, "momentum", resume_from=EncoderModel.load(spark, path)))
