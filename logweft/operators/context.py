"""Context: rows around the anchors, by place or by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import ORD
from ..functions.coerce import ts
from ..functions.expressions import Scope
from ..plans.syntax import QueryError
from .numbering import running

MARK, GROUP = "_m", "_group"


def around(rows: DataFrame, anchors: DataFrame, before: int = 0, after: int = 0, span_us: int = 0, time_field: str = "ts", partition: tuple[str, ...] = ()) -> DataFrame:
    """rows (with the order in __ord) near the anchors (rows that still carry it): the mark first, then the columns, and
    the number of the group, which a gap ends.

    Nothing runs in one task: with `partition` columns windows run by those; without them rows get a place each, and
    meet the places and times that the anchors ask for by joins."""
    if ORD not in anchors.columns:
        raise QueryError("context needs a query that keeps its rows")
    hit = anchors.select(ORD).distinct().withColumn("__hit", F.lit(1))
    df = rows.join(hit, ORD, "left").withColumn("__hit", F.coalesce("__hit", F.lit(0)))
    if span_us:
        df = df.withColumn("__t", F.unix_micros(ts(Scope(rows).field(time_field)).cast("timestamp")))
    df = _by_window(df, before, after, span_us, partition) if partition else _by_joins(df, before, after, span_us)
    kept = [F.col(f"`{n}`") for n in rows.columns if n != ORD]
    return df.orderBy(ORD).select(F.when(F.col("__hit") == 1, ">").otherwise("").alias(MARK), *kept, GROUP)


def _by_window(df: DataFrame, before: int, after: int, span_us: int, partition: tuple[str, ...]) -> DataFrame:
    by = Window.partitionBy(*[F.col(p) for p in partition])
    near = F.max("__hit").over(by.orderBy(ORD).rowsBetween(-after, before)) == 1
    if span_us:
        near = near | (F.col("__t").isNotNull() & (F.max("__hit").over(by.orderBy("__t").rangeBetween(-span_us, span_us)) == 1))
    df = df.withColumn("__place", F.row_number().over(by.orderBy(ORD))).withColumn("__near", near).filter("__near OR __hit = 1")
    island = F.col("__place") - F.row_number().over(by.orderBy(ORD))
    return df.withColumn("__island", island).withColumn(GROUP, F.dense_rank().over(by.orderBy("__island")))


def _by_joins(df: DataFrame, before: int, after: int, span_us: int) -> DataFrame:
    df = running(df, "__place", order=(F.col(ORD),))
    hits = df.filter("__hit = 1")
    asked = hits.select(F.explode(F.sequence(F.col("__place") - before, F.col("__place") + after)).alias("__place")).distinct()
    near = asked.withColumn("__near", F.lit(True))
    df = df.join(near, "__place", "left")
    if span_us:
        # In slots as wide as the span: an anchor of the same slot is near enough, of the slot before the last one
        # decides, and of the slot after the first one.
        slot = lambda t: F.floor(F.col(t) / span_us).cast("long")
        ends = hits.filter("__t IS NOT NULL").groupBy(slot("__t").alias("__s")).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
        around_ = ends.select(F.explode(F.array(*[F.struct((F.col("__s") + d).alias("s"), F.lit(d).alias("d"), "__lo", "__hi") for d in (-1, 0, 1)])).alias("x")).select("x.*")
        # d = 1: an anchor lies in the slot before; d = -1: in the slot after.
        slots = around_.groupBy(F.col("s").alias("__slot")).agg(F.max(F.when(F.col("d") == 0, True)).alias("__same"), F.max(F.when(F.col("d") == 1, F.col("__hi"))).alias("__last"), F.min(F.when(F.col("d") == -1, F.col("__lo"))).alias("__next"))
        timed = df.withColumn("__slot", slot("__t")).join(slots, "__slot", "left")
        in_time = F.coalesce("__same", F.lit(False)) | F.coalesce(F.col("__last") >= F.col("__t") - span_us, F.lit(False)) | F.coalesce(F.col("__next") <= F.col("__t") + span_us, F.lit(False))
        df = timed.withColumn("__near", F.coalesce("__near", F.lit(False)) | in_time)
    kept = df.filter("__near OR __hit = 1")
    # A row whose neighbour before isn't there begins a group.
    follows = kept.select((F.col("__place") + 1).alias("__place"), F.lit(True).alias("__follows"))
    flagged = kept.join(follows, "__place", "left")
    return running(flagged, GROUP, flag=F.col("__follows").isNull(), order=(F.col("__place"),))
