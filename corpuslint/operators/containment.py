"""Which nodes lie inside which, from nested-set numbers, by sweeps instead of pairs.

An interval row has `pre` and `last`, a point row has `pre`; x is inside y when
``y.pre <= x.pre <= y.last``. A sweep walks one file's events in order of position (at
one position an interval opens, then points count, then intervals close) with running
sums, so the work is that of sorting the events, however many intervals lie in each
other. Both sweeps partition by ``(repo, path)``: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE = ["repo", "path"]
OPEN, POINT, CLOSE = 0, 1, 2


def _events(df: DataFrame, pos: str, kind: int, step: int, carried: list[str]) -> DataFrame:
    return df.select(*FILE, F.col(pos).alias("pos"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), *carried)


def points_inside(intervals: DataFrame, points: DataFrame, carried: list[str]) -> DataFrame:
    """The intervals (`carried` columns, one of which names the interval in its file) with n, the points inside; none without."""
    nothing = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in carried]
    events = (_events(intervals, "pre", OPEN, 0, carried).unionByName(_events(intervals, "last", CLOSE, 0, carried))
              .unionByName(points.select(*FILE, F.col("pre").alias("pos"), F.lit(POINT).alias("kind"), F.lit(1).alias("step"), *nothing)))
    before = F.sum("step").over(Window.partitionBy(*FILE).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = events.withColumn("before", before).filter(F.col("kind") != POINT)
    n = F.sum(F.when(F.col("kind") == CLOSE, F.col("before")).otherwise(-F.col("before")))
    return swept.groupBy(*FILE, *carried).agg(n.cast("bigint").alias("n")).filter("n > 0")


def enclosing(points: DataFrame, intervals: DataFrame, name: str, carried: list[str]) -> DataFrame:
    """One row for each point and each interval around it: the point's `carried` columns and the interval's `name`.

    The first sweep gives depths. A point of depth d has one enclosing interval at each
    depth k <= d, the last one of that depth opened before it; so the points are laid out
    once for each k (as many rows as the result has) and a second sweep carries the last
    opened interval along.
    """
    kind_of = intervals.schema[name].dataType
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried]
    no_name: Column = F.lit(None).cast(kind_of).alias(name)
    opened = _events(intervals, "pre", OPEN, 1, [name]).select("*", *nothing)
    closed = _events(intervals, "last", CLOSE, -1, [name]).select("*", *nothing)
    met = _events(points, "pre", POINT, 0, carried).select(*FILE, "pos", "kind", "step", no_name, *carried)
    depth = F.sum("step").over(Window.partitionBy(*FILE).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = opened.unionByName(closed).unionByName(met).withColumn("depth", depth).filter(F.col("kind") != CLOSE)
    levels = F.when(F.col("kind") == OPEN, F.array("depth")).otherwise(F.sequence(F.lit(1).cast("bigint"), F.col("depth")))
    laid = swept.filter("depth > 0").select(*FILE, "pos", "kind", name, *carried, F.explode(levels).alias("k"))
    last = F.last(name, ignorenulls=True).over(Window.partitionBy(*FILE, "k").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return laid.withColumn("_around", last).filter(F.col("kind") == POINT).select(*FILE, F.col("_around").alias(name), *carried)
