"""SQL text shared by the oracle queries."""

from __future__ import annotations

from kinfold.functions.permutation import ROUNDS
from kinfold.functions.text import default_stop_words

SEED = 42
MAX_FEATURES = 10_000  # default vocabulary size


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE CAST(round({expr}, {digits}) AS DOUBLE) END"


def key(seed, *columns: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"md5(concat_ws(':', '{seed}', {parts}))"


def word(digest: str, n: int = 0) -> str:
    return f"CAST('0x' || substr({digest}, {1 + 8 * n}, 8) AS BIGINT)"


def uniform(seed, *columns: str) -> str:
    return f"({word(key(seed, *columns))} / 4294967296.0)"


def permutation(name: str, n: str, seed) -> str:
    """CTE ``name(x, y)``: the places y of the numbers x below ``n`` (a scalar query) in a seeded permutation.

    It may be used where ``WITH RECURSIVE`` opens the query.
    """
    rounds, before = [], f"{name}_0"
    for k in range(ROUNDS):
        rounds.append(
            f"{name}_{k + 1} AS (SELECT x, r AS l, (l + {word(key(f'{seed}:{k}', 'r'))}) % a AS r, a, n FROM {before})"
        )
        before = f"{name}_{k + 1}"
    return f"""{name}_n AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT CAST(({n}) AS BIGINT) AS n)),
{name}_0 AS (SELECT x, x // a AS l, x % a AS r, a, n FROM (SELECT unnest(range(a * a)) AS x, a, n FROM {name}_n)),
{', '.join(rounds)},
{name}_m AS (SELECT x, l * a + r AS y, n FROM {before}),
{name}_w AS (SELECT x, y, n FROM {name}_m WHERE x < n
  UNION ALL SELECT w.x, m.y, m.n FROM {name}_w w JOIN {name}_m m ON w.y = m.x WHERE w.y >= w.n),
{name} AS (SELECT x, y FROM {name}_w WHERE y < n)"""


def xavier(components: int) -> str:
    """CTEs ``term``, ``comp`` and the initial weights ``w(term_id, component, w)``."""
    return f"""term AS (SELECT CAST(range AS INTEGER) AS term_id FROM range({MAX_FEATURES})),
comp AS (SELECT CAST(range AS INTEGER) AS component FROM range({components})),
w AS (SELECT term_id, component,
             ({uniform(SEED, 'term_id', 'component')} * 2 - 1) * sqrt(6.0 / ({MAX_FEATURES} + {components})) AS w
      FROM term, comp)"""


ARTICLES = """articles AS (
  SELECT doc_id, text AS main_content,
         concat('【', source, '（', lang, '）】', text) AS title,
         concat('即時', lang) AS category_publish_name, source, lang
  FROM documents)"""

_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words())


def terms(source: str = "documents", where: str = "true", prefix: str = "", stop: bool = True) -> str:
    """CTEs ``dt(doc_id, term, n)`` and ``nd(n_docs)`` over some documents."""
    drop = f"WHERE term NOT IN ({_WORDS})" if stop else ""
    return f"""{prefix}tok AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM {source} WHERE {where}),
{prefix}dt AS (SELECT doc_id, term, count(*) AS n FROM {prefix}tok {drop} GROUP BY doc_id, term),
{prefix}nd AS (SELECT count(*) AS n_docs FROM {source} WHERE {where})"""


def vocab(k: int = MAX_FEATURES, prefix: str = "") -> str:
    """CTE ``vocab(term_id, term, df, tf)`` on top of ``terms``."""
    return f"""{prefix}st AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM {prefix}dt GROUP BY term),
{prefix}kept AS (
  SELECT term, df, tf FROM {prefix}st, {prefix}nd WHERE df <= 0.99 * n_docs ORDER BY tf DESC, term LIMIT {k}),
{prefix}vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df, tf FROM {prefix}kept)"""


def counts(prefix: str = "", vocab_prefix: str | None = None) -> str:
    v = prefix if vocab_prefix is None else vocab_prefix
    return f"""{prefix}cnt AS (
  SELECT doc_id, term_id, CAST(n AS DOUBLE) AS value FROM {prefix}dt JOIN {v}vocab USING (term))"""


def tfidf(prefix: str = "", vocab_prefix: str | None = None) -> str:
    v = prefix if vocab_prefix is None else vocab_prefix
    return f"""{prefix}raw AS (
  SELECT doc_id, term_id, value * (ln((1.0 + n_docs) / (1 + df)) + 1) AS w
  FROM {prefix}cnt JOIN {v}vocab USING (term_id), {v}nd),
{prefix}tfidf AS (
  SELECT doc_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM {prefix}raw)"""


VECTORS = ",\n".join([terms(), vocab(), counts(), tfidf()])
