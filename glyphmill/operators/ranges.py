"""Sums over the rows before, without a task that holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.storage import materialize


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows of its key that come before it in `order` (columns, which tell a key's rows apart), 0 for the first.

    Rows are dealt by ranges of (keys, order), summed up within each range, and the sums of a key's earlier ranges are added, so a key
    that holds most of the rows is many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    total = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__range"))
    per = dealt.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum")).withColumn("__earlier", total - F.col("__sum")).drop("__sum")
    own = F.sum(value).over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return dealt.withColumn("__own", own).join(per, [*keys, "__range"]).withColumn(name, F.col("__earlier") + F.col("__own")).drop("__range", "__own", "__earlier")
