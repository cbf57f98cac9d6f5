"""Places of rows within their groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.llm.shared import Scratch


def ranked(rows: DataFrame, group: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``i``, their place from 0 within their group, in the given ascending order.

    Rows are dealt to partitions by ranges of (group, order), so that a group that holds most rows is spread over
    many partitions; a row's place is its rank within (group, partition) plus the running count of the partitions before.
    ``order`` must tell all rows apart for places to repeat between runs. ``rows`` must be cheap to read
    twice (the ranges come from a sample), ``group`` is never null, and columns named __p, __n and i are replaced.
    """
    dealt = scratch.put(rows.repartitionByRange(F.col(group), *order).withColumn("__p", F.spark_partition_id()), "dealt")
    running = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(group, "__p").agg(F.count("*").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(running), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(group, "__p").orderBy(*order))
    return dealt.withColumn("i", rank.cast("long")).join(before, [group, "__p"]).withColumn("i", F.col("i") + F.col("__n") - 1).drop("__p", "__n")
