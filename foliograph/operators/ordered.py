"""Running sums over long ordered streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, group: str, seq: str, value: Column, name: str, span: int = 1 << 16) -> DataFrame:
    """The sum of ``value`` over a group's rows up to each row, in the order of the whole number ``seq``.

    The order is cut into spans of ``span`` numbers: sums run inside a span, and the totals of the spans before, one small
    row each, are added. So a group of any size is spread over tasks. Null values count as 0.
    """
    x = rows.withColumn("_v", F.coalesce(value.cast("long"), F.lit(0))).withColumn("_b", F.floor(F.col(seq) / span))
    totals = x.groupBy(group, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("_g"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = x.withColumn("_in", F.sum("_v").over(inside)).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_sb")))
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_v", "_b", "_g", "_sb", "_start", "_in")
