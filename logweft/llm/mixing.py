"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a fixed 36-bit hash. The words of each source are summed by hash bucket; the buckets before the one
in which the budget runs out are taken whole, and only that boundary bucket is split again by the next bits, until the
bits end. What is left is one threshold for each source: a document is taken if its hash is below. No sort, and a
larger budget always takes a superset of what a smaller one takes.

A target of up to twice a source's size is met by taking every document once and those below the threshold again.

Defined cases: null text has size 0; a null source is a source of its own and comes last; documents of size 0 are
kept by the threshold like any other and count 0 words; equal hashes (repeated ids) are taken or left together; an
empty table gives an empty result. Extra columns are kept by mix(), whatever their names. The figures of all sources
are ordered in one task, a row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, quoted, table

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in their order, repeating; the share of all words that the mix takes, as a fraction; the most that a document is taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
#: Hash bits, and bits of each histogram.
BITS, STEP = 36, 12


def size_of(text: Column) -> Column:
    """Number of words: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """36 bits of the id's MD5 (null: of the empty text), the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """sizes (__source, __total): adds __target. A row for each source, so these windows are small.

    A source is full where its share of what the fuller ones leave reaches its cap; in the order of cap / weight the
    full ones come first, so one pass settles all rounds of resharing. Whole numbers up to the last division."""
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    df = sizes.withColumn("__i", F.row_number().over(order))
    df = df.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("__i") - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    all_rows = Window.partitionBy()
    by_fill = Window.orderBy(F.col("__total") / F.col("__w"), "__i")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__all", F.sum("__total").over(all_rows)).withColumn("__cap", F.col("__total") * most)
    df = df.withColumn("__num", F.lit(share[0]) * F.col("__all") - F.lit(share[1]) * F.coalesce(F.sum("__cap").over(before), F.lit(0)))
    df = df.withColumn("__den", F.lit(share[1]) * (F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(before), F.lit(0))))
    df = df.withColumn("__full", F.col("__cap") * F.col("__den") <= F.col("__w") * F.col("__num"))
    first = lambda c: F.min_by(c, F.when(~F.col("__full"), F.struct(F.col("__total") / F.col("__w"), F.col("__i")))).over(all_rows)
    df = df.withColumn("__n1", first(F.col("__num"))).withColumn("__d1", first(F.col("__den")))
    share_of = F.try_divide((F.col("__w") * F.col("__n1")).cast("double"), F.col("__d1").cast("double"))
    df = df.withColumn("__target", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(share_of))
    return df.select("__source", "__total", F.coalesce("__target", F.lit(0.0)).alias("__target"))


#: A table of sources is broadcast up to this many rows, else joined by shuffle.
SOURCES = 10_000


def thresholds(docs: DataFrame, goals: DataFrame, small: bool) -> tuple[DataFrame, str]:
    """docs (__source, __size, __hash); goals (__source, __goal: words to take below the threshold); small: goals may be
    broadcast.

    Returns __source and __limit: hashes below it hold at most __goal words, and one more cell would hold more; and the
    path of the table that this is read from."""
    spark = docs.sparkSession
    sent = F.broadcast if small else lambda df: df
    at = goals.select("__source", "__goal", F.lit(0).cast("long").alias("__limit"), F.lit(True).alias("__more"))
    inside, paths = docs, []
    for shift in range(BITS - STEP, -1, -STEP):
        cells = inside.groupBy("__source", F.shiftright("__hash", shift).alias("__cell")).agg(F.sum("__size").alias("__words"))
        upto = Window.partitionBy("__source").orderBy("__cell")
        cells = cells.withColumn("__upto", F.sum("__words").over(upto))
        found = cells.join(sent(at.select(F.col("__source").alias("__s"), "__goal", "__more")), F.col("__source").eqNullSafe(F.col("__s")))
        # The boundary cell: the first that goes over the goal. Without one, all that is inside is taken.
        step = found.filter("__more").groupBy("__source").agg(F.min(F.when(F.col("__upto") > F.col("__goal"), F.col("__cell"))).alias("__b"), F.max(F.when(F.col("__upto") <= F.col("__goal"), F.col("__upto"))).alias("__got"))
        step = step.select(F.col("__source").alias("__s"), "__b", F.coalesce("__got", F.lit(0)).alias("__got"))
        at = at.join(sent(step), F.col("__source").eqNullSafe(F.col("__s")), "left").select(
            "__source",
            (F.col("__goal") - F.coalesce("__got", F.lit(0))).alias("__goal"),
            F.when(F.col("__b").isNotNull(), F.shiftleft("__b", shift)).when(F.col("__more"), F.lit(1 << BITS)).otherwise(F.col("__limit")).alias("__limit"),
            (F.col("__more") & F.col("__b").isNotNull()).alias("__more"),
        )
        at, path = cut(at.coalesce(1) if small else at, "mix-limits")
        paths.append(path)
        if shift:
            edge = at.filter("__more").select(F.col("__source").alias("__s"), F.shiftright("__limit", shift).alias("__b"))
            inside = inside.join(sent(edge), F.col("__source").eqNullSafe(F.col("__s")) & (F.shiftright("__hash", shift) == F.col("__b"))).select("__source", "__size", "__hash")
    drop(spark, *paths[:-1])
    return at.select("__source", "__limit"), paths[-1]


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, source) -> (one row for each: doc_id, __source, __size, __hash; one row for each source, which
    may be marked for broadcast: __s, __total, __target, __base, __limit)."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("source").alias("__source"), size_of(F.col("text")).alias("__size"), hash_of(F.col("doc_id")).alias("__hash"))
    base, _ = cut(base, "mix-sizes")
    totals = targets(base.groupBy("__source").agg(F.sum("__size").alias("__total")), weights, share, most)
    # Copies that every document gives, and the words that those below the threshold add.
    totals = totals.withColumn("__base", F.when(F.col("__total") > 0, F.least(F.lit(most - 1), F.floor(F.col("__target") / F.col("__total")))).otherwise(0).cast("long"))
    totals, totals_path = cut(totals.withColumn("__goal", F.col("__target") - F.col("__base") * F.col("__total")), "mix-targets")
    small = totals.count() <= SOURCES
    limits, limits_path = thresholds(base.select("__source", "__size", "__hash"), totals.select("__source", "__goal"), small)
    limits = limits.withColumnRenamed("__source", "__s")
    sources, _ = cut(totals.join(F.broadcast(limits) if small else limits, F.col("__source").eqNullSafe(F.col("__s")), "left").select(F.col("__source").alias("__s"), "__total", "__target", "__base", "__limit"), "mix-sources")
    drop(spark, totals_path, limits_path)
    return base, F.broadcast(sources) if small else sources


def _copies(hash_: Column) -> Column:
    """How often the mix takes a document, by its source's figures."""
    return F.col("__base") + F.when(hash_ < F.col("__limit"), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """The mixed documents, each as often as it is taken; the columns of docs."""
    _, sources = plan(docs.select("doc_id", "text", "source"), weights, share, most)
    # The whole row as one value, so that none of its names can clash.
    whole = docs.select(F.struct(*quoted(*docs.columns)).alias("__row"))
    taken = whole.join(sources, F.col("__row.source").eqNullSafe(F.col("__s")), "left").withColumn("__copies", _copies(hash_of(F.col("__row.doc_id"))))
    times = reduce(lambda c, k: F.when(F.col("__copies") >= k, F.array(*[F.lit(i) for i in range(k)])).otherwise(c), range(1, most + 1), F.array().cast("array<int>"))
    return taken.filter("__copies > 0").select("__row", F.explode(times)).select("__row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    base, sources = plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    out = base.join(sources, F.col("__source").eqNullSafe(F.col("__s")), "left")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * _copies(F.col("__hash"))).alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[((i - 1) % {len(WEIGHTS)}) + 1]::BIGINT AS w FROM s),
a AS (SELECT *, total * {MOST} AS cap, {SHARE[0]} * sum(total) OVER () - {SHARE[1]} * coalesce(sum(total * {MOST}) OVER (ORDER BY total / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  {SHARE[1]} * (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY total / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS den FROM w),
f AS (SELECT *, cap * den <= w * num AS is_full FROM a),
r AS (SELECT num AS n1, den AS d1 FROM f WHERE NOT is_full ORDER BY total / w, i LIMIT 1),
t AS (SELECT source, total, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * n1)::DOUBLE / d1::DOUBLE END AS target FROM f LEFT JOIN r ON true),
g AS (SELECT *, CASE WHEN total > 0 THEN least({MOST - 1}, floor(target / total))::BIGINT ELSE 0 END AS base FROM t),
c AS (SELECT d.doc_id, d.size, g.total, g.target, g.base, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= g.target - g.base * g.total AS more
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, total AS source_size, coalesce(target, 0) AS target, (size * (base + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
