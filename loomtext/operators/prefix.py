"""Running sums in a full order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.runtime import Scratch


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows up to each one, in an order without ties.

    Rows are dealt by range and written, so that a range is the same wherever it is read; each range sums
    its own rows, and the sums of the ranges before it (one row each) are broadcast.
    """
    dealt = Scratch(rows.sparkSession, "running").write(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "rows")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_own"))
    before = sums.select("_range", (F.sum("_own").over(Window.orderBy("_range")) - F.col("_own")).alias("_before"))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.sum(value).over(w) + F.col("_before")).drop("_range", "_before")
