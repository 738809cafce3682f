"""The `issues` table and helpers shared by the rule families.

An issue row: repo, agent, rule_id, title, description, severity, path, line,
confidence, evidence, seq. ``seq`` is the order key (family rank, rule/section,
path order, position, minor, tie string); it is carried as a column and only
sorted on in report queries and sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.functions.columns import path_key

ISSUE_COLUMNS = ["repo", "agent", "rule_id", "title", "description", "severity", "path", "line",
                 "confidence", "evidence", "seq"]

SEQ_TYPE = "struct<a:int,b:int,c:array<string>,d:bigint,e:bigint,f:string>"

ISSUE_TYPES = ["string"] * 7 + ["int", "double", "array<string>", SEQ_TYPE]

ISSUE_SCHEMA = ", ".join(f"{c} {kind}" for c, kind in zip(ISSUE_COLUMNS, ISSUE_TYPES))


def seq(agent: str, b: int | Column, path: Column | None, d: Column | int = 0, e: Column | int = 0,
        f: Column | str = "") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(C.FAMILY_RANK[agent]).cast("int").alias("a"),
        lit(b).cast("int").alias("b"),
        (path_key(path) if path is not None else F.expr("cast(array() as array<string>)")).alias("c"),
        lit(d).cast("bigint").alias("d"),
        lit(e).cast("bigint").alias("e"),
        lit(f).cast("string").alias("f"),
    )


def make_issues(df: DataFrame, rule_id: str, *, path: Column, line: Column | None, evidence: Column,
                order: Column) -> DataFrame:
    """Project rows of ``df`` into issue rows of one catalogue rule (literal columns)."""
    title, desc, sev, conf = C.RULES[rule_id]
    agent = rule_id.split(".", 1)[0]
    return df.select(
        F.col("repo"),
        F.lit(agent).alias("agent"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(title).alias("title"),
        F.lit(desc).alias("description"),
        F.lit(sev).alias("severity"),
        path.alias("path"),
        (line if line is not None else F.lit(None)).cast("int").alias("line"),
        F.lit(conf).cast("double").alias("confidence"),
        evidence.cast("array<string>").alias("evidence"),
        order.alias("seq"),
    )


def catalogue_lookup(rule_col: Column, field: int) -> Column:
    """Map lookup into the rule catalogue (for rows whose rule id is data, not a literal)."""
    m = F.create_map(*[x for k, v in C.RULES.items() for x in (F.lit(k), F.lit(v[field]))])
    return m[rule_col]


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def empty_issues(spark) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def as_issues(df: DataFrame) -> DataFrame:
    """The issue columns of ``df`` in their order and types, as tables of several rules share them."""
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in zip(ISSUE_COLUMNS, ISSUE_TYPES)])
