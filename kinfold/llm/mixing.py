"""Mixing sources to target weights: repetition rates and whole copies.

The words of each source are summed, the sources share all words by weight, and
a document is emitted ``floor(rate)`` times plus one copy more with a
probability equal to the rate's fraction. That draw hashes the row, so a
retried task repeats it. One source may hold a third of all rows: its rows
only ever meet in sums that are made per task first, and in a join against one
row per source, which Spark broadcasts if it is small and splits if it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import WORDS, materialize, stored, table, text_of, unpacked, whole_rows

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 32

# Fixed values of the draws: a row's two hash words a and b give, for seed k,
# the word (a * (FIRST + k * STEP) + b) mod 2^32.
FIRST = 1_640_531_527
STEP = 10_000_018
WORD = 1 << 32


def size_of(name: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(text_of(name), F.lit(WORDS)).cast("long")


def draw_words(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Two 32-bit words, hashed from the id and the whole text of a row."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), text_of(text)))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(word(1).alias("a"), word(9).alias("b"))


def _draw(a: str, b: str, seed: Column) -> Column:
    return (F.col(a) % (WORD // 2) * (F.lit(FIRST) + seed * STEP) + F.col(b)) % WORD / float(WORD)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources are weighted by code point, null last. With the water level L, a
    target is ``min(L * weight, cap * size)`` and all targets sum to all words.
    Sources are ranked in one window, a row of a few dozen bytes each, which
    holds for some 10^7 sources. In the order of ``cap * size / weight`` the levels that leave the first i
    sources at their cap rise to L and fall after it, so L is their largest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.withColumn("n", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * cap)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = Window.partitionBy()
    level = (F.sum("source_size").over(full) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = ranked.withColumn("level", level)
    levels = levels.withColumn("water", F.max("level").over(full))
    target = F.least(F.col("water") * F.col("weight"), F.col("limit").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def mixing_rates(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS
) -> DataFrame:
    """One row per source: its target, whole copies, fraction and chosen seed.

    ``sized`` has source, size and the draw words ``a`` and ``b``. Of ``seeds``
    seeds a source takes the one whose draws come nearest to its target.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rates = targets.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    rates = stored(rates.withColumn("fraction", F.col("rate") - F.col("whole")), "mixing-rates")
    drawn = sized.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    taken = [
        F.sum(F.when(_draw("a", "b", F.lit(k)) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"s{k}")
        for k in range(seeds)
    ]
    sums = drawn.groupBy("of").agg(F.first("target").alias("t"), F.first("whole").alias("w"), F.first("source_size").alias("n"), *taken)
    gaps = [
        F.struct(F.abs(F.col("w") * F.col("n") + F.col(f"s{k}") - F.col("t")).alias("gap"), F.lit(k).alias("seed"))
        for k in range(seeds)
    ]
    best = sums.select(F.col("of"), F.array_min(F.array(*gaps))["seed"].alias("seed"))
    return stored(
        rates.join(best, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "mixing-seeds"
    )


def with_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Join rows that carry source, ``a`` and ``b`` with their number of copies."""
    named = rates.select(*[F.col(c).alias(f"mix_{c}") for c in rates.columns])
    joined = rows.join(named, rows["source"].eqNullSafe(named["mix_source"]), "left")
    extra = (_draw("a", "b", F.col("mix_seed")) < F.col("mix_fraction")).cast("long")
    return joined.withColumn("mix_copies", F.col("mix_whole") + extra)


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source)``.

    Returns doc_id, size, source_size, target, taken and copies, a row per
    input row. A null text has no words; a null source is a source of its own,
    last in order; rows without words are emitted like others and take none; a
    source without any words has rate 1, so that its rows stay; repeated rows share their draw; an empty table gives an empty plan; other
    columns are ignored.
    """
    sized = docs.select("doc_id", "source", size_of().alias("size"), draw_words().alias("draw"))
    sized = materialize(sized.select("doc_id", "source", "size", "draw.a", "draw.b"), "mixing-sizes")
    plan = with_copies(sized, mixing_rates(sized, weights, cap))
    return plan.select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, with all its columns.

    Nulls, rows and sources without words, and repeated rows as in
    ``mixing_plan``; an empty table stays empty; columns may have any names.
    """
    sized = docs.select("source", size_of().alias("size"), draw_words().alias("draw"))
    sized = materialize(sized.select("source", "size", "draw.a", "draw.b"), "mixing-sizes")
    rows = whole_rows(docs).withColumn("draw", draw_words("row.doc_id", "row.text"))
    rows = rows.select("row", F.col("row.source").alias("source"), "draw.a", "draw.b")
    copied = with_copies(rows, mixing_rates(sized, weights, cap))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))
    return unpacked(copied.select("row", copies), docs.columns)


def op7_mixing(spark, sf_dir):
    return mixing_plan(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', coalesce(text, ''))) AS h FROM documents),
w AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
g AS (SELECT *, CASE n % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight,
             {CAP} * source_size AS lim FROM r),
v AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0) AS DOUBLE)
              / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS lev
      FROM g WINDOW o AS (ORDER BY lim / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(max(lev) OVER () * weight, CAST(lim AS DOUBLE)) AS target FROM v),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1 END AS rate FROM t),
f AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS fraction FROM q),
k AS (SELECT f.source, k.seed, abs(whole * source_size + coalesce(sum(size) FILTER (
        ((a % {WORD // 2}) * ({FIRST} + k.seed * {STEP}) + b) % {WORD} / {float(WORD)} < fraction), 0) - target) AS gap
      FROM w JOIN f ON w.source IS NOT DISTINCT FROM f.source, (SELECT unnest(range({SEEDS})) AS seed) k
      GROUP BY f.source, k.seed, whole, source_size, target),
p AS (SELECT source, arg_min(seed, (gap, seed)) AS seed FROM k GROUP BY source),
c AS (SELECT w.*, f.source_size, f.target, whole + CAST(
        ((a % {WORD // 2}) * ({FIRST} + p.seed * {STEP}) + b) % {WORD} / {float(WORD)} < fraction AS BIGINT) AS copies
      FROM w JOIN f ON w.source IS NOT DISTINCT FROM f.source JOIN p ON w.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
