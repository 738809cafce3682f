"""Positions of rows within a group, without a task that holds the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslint.session import cut_lineage


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's position (from 1) among the rows of its group in the given order.

    Rows are dealt to ranges of (group, order) and written once: the bounds of ranges are
    sampled, so they must not be drawn a second time. A row's position is its place in its
    range plus the group's rows in the ranges before, a running sum over one row per group
    and range. A group of a third of all rows spreads over a third of the ranges. Rows with
    equal keys share a range and are numbered in any order; null groups are a group.
    """
    keys = [k.alias(f"_key{i}") for i, k in enumerate(order)]
    names = [f"_key{i}" for i in range(len(order))]
    ranged = df.select("*", *keys).repartitionByRange(F.col(group), *names).withColumn("_range", F.spark_partition_id())
    rows = cut_lineage(ranged)
    counts = rows.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*names)))
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_place")).cast("int").alias(name))
