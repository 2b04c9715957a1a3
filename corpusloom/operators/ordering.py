"""Orders and numbers that hold for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, parallelism


def numbered(rows: DataFrame, key: str, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """`rows` with the place of each row among the rows of its key, counted from `start`.

    The rows are range-sorted on (key, order), so a key of any size spreads over
    several partitions; each partition adds the number of the key's rows in the
    partitions before it.  The order should be total: rows that tie in it are
    numbered in an arbitrary order.
    """
    spark = rows.sparkSession
    placed = cut(rows.repartitionByRange(parallelism(spark), key, *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0").select(F.col(key).alias("__key"), F.col("__part").alias("__at"), "__before")
    here = F.row_number().over(Window.partitionBy("__part", key).orderBy(*order))
    joined = placed.withColumn("__here", here).join(before, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__at")), "left")
    place = F.col("__here") + F.coalesce("__before", F.lit(0)) + (start - 1)
    return joined.withColumn(name, place.cast("int")).drop("__part", "__key", "__at", "__before", "__here")


def summed(rows: DataFrame, key: str, order: list[str | Column], value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over the rows of their key up to them, in a total order; a key of any size spreads as in `numbered`."""
    placed = cut(rows.repartitionByRange(parallelism(rows.sparkSession), key, *order).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy(key, "__part").agg(F.sum(value).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.sum("__n").over(earlier)).where("__before is not null").select(F.col(key).alias("__key"), F.col("__part").alias("__at"), "__before")
    here = F.sum(value).over(Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("__here", here).join(before, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__at")), "left")
    return joined.withColumn(name, F.col("__here") + F.coalesce("__before", F.lit(0))).drop("__part", "__key", "__at", "__before", "__here")


def latest(rows: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """The row of each key with the greatest `by`; ties go to the greatest `columns` in turn.  Aggregated before the shuffle."""
    best = F.max(F.struct(*by, *[c for c in columns if c not in by])).alias("__best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])
