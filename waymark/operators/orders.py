"""Ranks over whole tables without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.scratch import kept

#: Decimals of scores and confidences as they are told; what is equal to these is a tie.
TOLD = 9


def strength() -> Column:
    """What interests (score, confidence) are ordered by: the product of both as they are told, so that it orders what a reader sees."""
    return F.round(F.round("score", TOLD) * F.round("confidence", TOLD), TOLD)


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's place in the order, from 1: rows are dealt by range, numbered within a part, and shifted by the parts before.

    What one task numbers in sequence is a row a part. The order should tell all rows apart.
    """
    part, shift = f"{name}_part", f"{name}_shift"
    rows = kept(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    shifts = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(shift))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    rows = rows.withColumn(name, nth).join(F.broadcast(shifts), part)  # a row a part
    return rows.withColumn(name, (F.col(name) + F.col(shift)).cast("long")).drop(part, shift)
