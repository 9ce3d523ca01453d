"""Dense numbers over a whole table without one partition that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import held


def numbered_on(rows: DataFrame, order: Sequence[Column], start: Column, name: str = "seq") -> DataFrame:
    """``rows`` with numbers from ``start`` + 1 on in ``order``, which must tell rows apart.

    Rows are range-partitioned by the order; each range is numbered for itself, from the count of the ranges before it.
    The counts are one row a partition. The dealt rows are held: dealt twice, for the rows and for the counts, the ranges
    would be of two samples, and adaptive execution would join other neighbours to one partition.
    """
    ranged = held(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*order)
    placed = ranged.withColumn("__place", F.row_number().over(own))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(counts), "__part").withColumn(name, start + F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
