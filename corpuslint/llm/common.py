"""Small helpers shared by the operators: words, scratch tables, session settings, connected components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslint.session import ensure_checkpoint_dir

#: Words are maximal runs without these characters (space, tab, line feed, vertical tab, form feed, carriage return).
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that the writer of an intermediate table holds before it gives them out (128 MB by default, for each task).
ROW_GROUP = 16 << 20


class Scratch:
    """Intermediate tables of one operator call, in the cluster's shared checkpoint folder.

    A written table cuts the lineage and outlives any executor. `drop` removes a
    table no later step reads; what the returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        with released_shuffles(self.spark):
            writer = df.write
            (writer.partitionBy(partition_by) if partition_by else writer).option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._alive = getattr(self, "_alive", []) + [out]
        return out

    def together(self, *frames: DataFrame) -> DataFrame:
        """The rows of several kept tables of one schema, read as one table."""
        return self.spark.read.schema(frames[0].schema).parquet(*[self.paths[id(df)] for df in frames])

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(df)])
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set session options (dots written as double underscores) for the jobs run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def released_shuffles(spark: SparkSession):
    """Shuffle files of a finished write are removed at once, not when the driver collects garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Large-star and small-star steps alternate until every component is a star.
    Every step is a minimum per node (combined map-side) and a join on the node,
    which adaptive execution splits when one node has very many edges. Each step
    is written once.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    cur = scratch.keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(cur):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large)
        # every edge now points from the larger node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(joined.select("u", F.col("m").alias("v"))).distinct())
        small = scratch.keep(small)
        scratch.drop(cur, large)
        cur = small
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v), u > v, is its u's only one and leads to a node without a smaller neighbour."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up = 1 and down = 1)").agg(F.count(F.lit(1))).first()[0] == 0


def merged_components(scratch: Scratch, comps: DataFrame, edges: DataFrame) -> DataFrame:
    """`comps` (node, component) after further edges (a, b): the components are joined, not searched anew."""
    of_a = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = (edges.join(of_a, "a", "left").join(of_b, "b", "left")
               .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    top = connected_components(scratch, between)
    up = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = comps.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return old.union(top.join(comps, "node", "left_anti"))
