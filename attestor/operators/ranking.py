"""Global ranks and running sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_running_sum(df: DataFrame, weight: Column | str, *order: str, name: str, partitions: int | None = None) -> DataFrame:
    """df with ``name``: the sum of ``weight`` up to and including each row, in ascending order of the columns.

    Rows are dealt by ranges and summed within each; the ranges' totals (one number each) give the
    offsets. The dealt rows are written by checkpoint(), because the ranges' borders are sampled.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.col(weight) if isinstance(weight, str) else weight
    dealt = df.withColumn("_weight", weight).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("_range").agg(F.sum("_weight").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_range", before.alias("_offset"))  # one row for each range
    inside = F.sum("_weight").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_range")
    return summed.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_range", "_offset", "_inside", "_weight")


def global_row_number(df: DataFrame, *order: str, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """df with ``name``: 1, 2, ... in ascending order of the columns."""
    return global_running_sum(df, F.lit(1), *order, name=name, partitions=partitions)
