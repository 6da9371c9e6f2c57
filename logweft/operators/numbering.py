"""Numbers over the rows of a frame in their order, without one task that sees them all."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() has the partition above these bits, and the row in it below.
ROW_BITS = 33


def checkpoint_folder(spark: SparkSession) -> None:
    """Where checkpoints go: the folder that the cluster names in spark.checkpoint.dir; where it is unset, one is set."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        os.makedirs(found.removeprefix("file://"), exist_ok=True)
    spark.sparkContext.setCheckpointDir(found)


def running(df: DataFrame, name: str, start: int = 0, flag: Column | None = None, order: tuple[Column, ...] = ()) -> DataFrame:
    """df in its order (or in the given one) with a running number in column `name`: of the rows before, from `start`; or
    with a flag, of the rows up to here where it holds.

    The rows are checkpointed once with partition and place, so that their order is fixed; then a count for each
    partition says where its numbers begin."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    rows = (df.orderBy(*order) if order else df).withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__at", ROW_BITS))
    one = F.lit(1) if flag is None else flag.cast("long")
    rows = rows.withColumn("__one", one).checkpoint()
    # A row for each partition.
    before = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy(F.col("__p").alias("__q")).agg(F.sum("__one").alias("__n")).select("__q", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) if flag is None else F.sum("__one").over(Window.partitionBy("__p").orderBy("__at"))
    out = rows.withColumn("__inside", inside).join(F.broadcast(begins), F.col("__p") == F.col("__q"))
    return out.withColumn(name, (F.col("__before") + F.col("__inside") + start).cast("long")).drop("__at", "__p", "__one", "__q", "__before", "__inside")
