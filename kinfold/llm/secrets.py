"""Secret scans with corpus-wide ownership frequency.

Patterns find spans in each whole text. The values in them, and further long
tokens that look like keys, are candidates: their hashes are counted over the
corpus by distinct repositories and owners. What several owners have, or what
stands in many repositories of few owners, is a copied example; what else looks
random is live-looking, and such a token becomes a span of its own.

A value may stand in a third of all rows: counts are made per task, then per
(hash, owner, repository), so that only one row per repository and owner is
left where hashes meet. Joins are on the hash without an aggregate above, so a
hot one is split at run time. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, stored, table, text_of

# Kinds in their order, their patterns, and the least length of
# the value (for assignments: of group 2).
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OWNED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = (ASSIGN, ACCESS, HEX, OWNED)
ASSIGN_LEAST = 12

OWNERS = 3  # a value that this many owners have is a copied example
REPOSITORIES = 5  # and so is one in this many repositories, of however few owners
VARIETY = 8  # different characters of a value that looks random


def _running_sums(lengths: str) -> Column:
    """Sums of the array up to each element, in blocks of about the square root of its size.

    Appending to one array copies it each time; with blocks the work grows as
    the power 1.5 of the matches in a text.
    """
    step = f"CAST(ceil(sqrt(size({lengths}))) AS INT)"
    sums = (
        f"transform(sequence(0, {step} - 1), b -> aggregate(slice({lengths}, b * {step} + 1, {step}), 0L, (s, x) -> s + x))"
    )
    running = (
        "aggregate({0}, named_struct('s', {1}, 'a', CAST(array() AS ARRAY<BIGINT>)), "
        "(t, x) -> named_struct('s', t.s + x, 'a', concat(t.a, array(t.s + x))), t -> t.a)"
    )
    offsets = running.format(sums, "0L")
    inner = running.format(f"slice({lengths}, k * {step} + 1, {step})", "b.o - b.w")
    blocks = (
        f"transform(zip_with({offsets}, {sums}, (o, w) -> named_struct('o', o, 'w', w)), "
        f"(b, k) -> {inner})"
    )
    return F.expr(
        f"CASE WHEN size({lengths}) = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE flatten({blocks}) END"
    )


def _with_matches(rows: DataFrame, kind: int) -> DataFrame:
    """Add the array ``k<kind>`` of ``(start, kind, end, value)`` for one pattern.

    A text is split where the pattern matches, so lengths of the pieces and of
    the matches give the positions.
    """
    pattern, name = PATTERNS[kind], f"k{kind}"
    found = F.col("text").rlike(pattern)
    nothing = F.array().cast("array<string>")
    rows = rows.withColumn(
        f"{name}_m", F.when(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(nothing)
    )
    pieces = F.when(F.size(f"{name}_m") > 0, F.split("text", pattern, -1)).otherwise(nothing)
    rows = rows.withColumn(f"{name}_g", F.slice(pieces, 1, F.size(f"{name}_m")))
    lengths = F.zip_with(f"{name}_g", f"{name}_m", lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    rows = rows.withColumn(f"{name}_n", lengths).withColumn(f"{name}_e", _running_sums(f"{name}_n"))

    def span(end: Column, match: Column) -> Column:
        value = F.regexp_extract(match, pattern, 2) if kind == 0 else match
        return F.struct(
            (end - F.length(match)).alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            value.alias("value"),
        )

    spans = F.zip_with(f"{name}_e", f"{name}_m", span)
    if kind == 0:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    kept = [c for c in rows.columns if not c.startswith(f"{name}_")]
    return rows.withColumn(name, spans).select(*kept, name)


def looks_random(value: Column) -> Column:
    """Letters and digits, and many different ones."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= VARIETY)


def _named(span: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["kind"] + 1)
    return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), _named), ",")


def found_spans(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One stored row per document: its base spans, and the candidates with their hashes."""
    rows = docs.select(
        "doc_id", text_of().alias("text"), repository.alias("repository"), owner.alias("owner")
    )
    for kind in range(len(KINDS)):
        rows = _with_matches(rows, kind)
    mixed = r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
    rows = rows.withColumn("base", F.concat("k0", "k1", "k2"))
    free = F.filter(
        "k3",
        lambda c: c["value"].rlike(mixed)
        & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    rows = rows.withColumn("free", free)

    def candidate(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.unhex(F.sha2(s["value"], 256)).alias("hash"),
            looks_random(s["value"]).alias("random"),
        )

    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    slim = rows.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "repository",
        "owner",
        *[F.size(f"k{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        plain.alias("base"),
        F.transform(F.concat("base", "free"), candidate).alias("candidates"),
    )
    return materialize(slim, "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """``(hash, n_rows, n_repositories, n_owners)`` of every candidate; null names count as one."""
    each = spans.select("repository", "owner", F.explode("candidates").alias("c"))
    by_repository = each.groupBy(F.col("c.hash").alias("hash"), "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("hash").agg(
        F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")
    )


def secret_spans(
    docs: DataFrame, repository: Column, owner: Column, owners: int = OWNERS, repositories: int = REPOSITORIES
) -> DataFrame:
    """Secrets of ``docs(doc_id, text)``, a row per input row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, and as counts
    of spans n_owned (those the method adds), n_copied (values that at least
    ``owners`` owners have or that stand in at least ``repositories`` repositories)
    and n_live (random-looking values that are not copied); most_owners and
    most_repositories are the largest counts of a candidate of the row, 0 if it
    has none. A null or empty text has no spans; a null repository or owner
    counts as one of its own; repeated rows are rows of the same owner; an empty
    table gives an empty result; other columns are ignored.
    """
    known = found_spans(docs, repository, owner)
    # Written first: Spark splits a join at a hot value only if no aggregate ends on its key.
    counts = stored(ownership(known).select(F.col("hash").alias("of"), "n_owners", "n_repositories"), "secret-owners")
    each = known.select("row_id", F.explode("candidates").alias("c"))
    judged = each.join(counts, F.col("c.hash") == F.col("of"))
    copied = (F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories)
    live = ~copied & F.col("c.random")
    owned = live & (F.col("c.kind") == 3)
    judged = stored(
        judged.select(
            "row_id",
            F.when(owned, F.struct("c.start", "c.kind", "c.end")).alias("span"),
            live.cast("long").alias("live"),
            copied.cast("long").alias("copied"),
            "n_owners",
            "n_repositories",
        ),
        "secret-verdicts",
    )
    # The spans of one text, which its length bounds.
    added = judged.groupBy(F.col("row_id").alias("of")).agg(
        F.collect_list("span").alias("added"), F.sum("live").alias("n_live"), F.sum("copied").alias("n_copied"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )
    rows = known.join(added, known["row_id"] == added["of"], "left")
    none = F.array().cast(known.schema["base"].dataType)
    rows = rows.withColumn("added", F.coalesce("added", none))
    return rows.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_owned"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )


def op1_secrets(spark, sf_dir):
    """Sources stand for owners; a source's texts of one language and hundred of ids for a repository of that owner."""
    docs = table(spark, sf_dir, "documents")
    hundred = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit(""))
    repository = F.concat_ws("/", F.coalesce("lang", F.lit("")), hundred)
    return secret_spans(docs, repository, F.col("source"))


def _positions(kind: int, value: str, where: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''").replace("\\\"", '"')
    return f"""
p{kind} AS (SELECT doc_id, source, lang, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'm': m[i], 'stop': CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                    + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT)}}), recursive := true)
  FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '{pattern}') AS m,
               string_split_regex(text, '{pattern}') AS g FROM d)),
s{kind} AS (SELECT doc_id, source, lang, {kind} AS kind, stop - length(m) AS start, stop, {value} AS value
            FROM p{kind} WHERE {where})"""


_ASSIGN_SQL = ASSIGN.replace("'", "''").replace("\\\"", '"')
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents),
{_positions(0, f"regexp_extract(m, '{_ASSIGN_SQL}', 2)", f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= {ASSIGN_LEAST}")},
{_positions(1, "m", "true")},
{_positions(2, "m", "true")},
{_positions(3, "m", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')")},
base AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM s3 WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = s3.doc_id AND b.start < s3.stop AND s3.start < b.stop)),
own AS (SELECT value, count(DISTINCT {{'o': source}}) AS n_owners,
    count(DISTINCT {{'o': source, 'r': concat(coalesce(lang, ''), '/', floor(doc_id / 100))}}) AS n_repositories
  FROM cand GROUP BY value),
decided AS (SELECT cand.*, n_owners, n_repositories, n_owners >= {OWNERS} OR n_repositories >= {REPOSITORIES} AS copied
  FROM cand JOIN own USING (value)),
judged AS (SELECT *, NOT copied AND regexp_matches(value, '[0-9]')
    AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {VARIETY} AS live
  FROM decided),
kept AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS name
         FROM judged WHERE kind < 3 OR live),
each AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base,
    string_agg(name, ',' ORDER BY start, kind, stop) AS spans, count(*) FILTER (kind = 3) AS n_owned FROM kept GROUP BY doc_id),
tally AS (SELECT doc_id, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied,
    max(n_owners) AS most_owners, max(n_repositories) AS most_repositories FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN each USING (doc_id) LEFT JOIN tally USING (doc_id)
"""
