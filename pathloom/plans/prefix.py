"""Global running sums and dense numbers without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.plans.scratch import materialize

#: Consecutive keys that share a task in a running sum.
BUCKET = 1 << 16


def running_sum(df: DataFrame, key: str, value: Column, out: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over all smaller values of the integer ``key``.

    Two levels: sums of buckets of keys first (one row for ``bucket`` keys), then within
    each bucket.  ``key`` is unique.
    """
    d = df.withColumn("_b", F.floor(F.col(key) / F.lit(bucket))).withColumn("_v", value)
    sums = d.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A left join: where nobody asks for the sum, the optimizer drops all of this.
    return d.withColumn("_i", inside).join(before, "_b", "left").withColumn(out, F.col("_o") + F.col("_i")).drop("_b", "_v", "_i", "_o")


def dense_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` plus ``out``: 0, 1, 2, ... in the order of ``order``, which is a total one."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "indexed")
    counts = dealt.groupBy("_pid").count()  # a row for each partition
    before = counts.select("_pid", F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    nth = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return dealt.withColumn("_n", nth).join(before, "_pid").withColumn(out, (F.col("_o") + F.col("_n")).cast("long")).drop("_pid", "_n", "_o")
