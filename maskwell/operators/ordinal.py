"""Numbering rows of large groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.shared import materialize


def with_ordinal(df: DataFrame, group: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """``df`` with the 0-based position of each row in its group, in the given order.

    Rows are range-partitioned, so a frequent group spreads over many parts. A row's
    position is that inside its part plus the rows of its group in the parts before.
    """
    placed = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "ordinal")
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_part")
    before = sizes.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).drop("_n")
    joined = placed.withColumn("_inside", F.row_number().over(inside) - 1).join(before, [*group, "_part"])
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part")
