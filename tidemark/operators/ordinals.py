"""Row numbers over a global order without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def with_position(df: DataFrame, order: Sequence[str | Column], to: str = "position") -> DataFrame:
    """``df`` with each row's place from 0 in a total order.

    Rows are cut into ranges of even counts by sampling, numbered within their range and shifted by
    the counts of the ranges before: no task sees more than its range, however few the groups are.
    """
    cut = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "positions")
    own = cut.withColumn("__nth", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = cut.groupBy("__range").agg(F.count("*").alias("__rows")).select("__range", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__ahead"))
    return own.join(ranges, "__range").withColumn(to, F.col("__nth") + F.col("__ahead")).drop("__range", "__nth", "__ahead")
