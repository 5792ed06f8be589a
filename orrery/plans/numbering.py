"""Consecutive numbers in an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.plans.scratch import materialize


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """df with a number from 0 in the order of the given columns, which should tell all rows apart. Rows are sorted in ranges; only the ranges' sizes are summed in one place."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    part = materialize(part, "numbered")
    base = part.groupBy("_p").agg(F.count("*").alias("n"), F.min("_k").alias("_first"))
    base = base.withColumn("_base", F.sum("n").over(W.orderBy("_p")) - F.col("n")).select("_p", "_base", "_first")
    return part.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_k") - F.col("_first")).drop("_p", "_k", "_base", "_first")
