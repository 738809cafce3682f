"""Exact deduplication by skew-safe combining, full content compared at every stage.

1. Local: each map task merges its own equal texts (the partial aggregation of a
   grouping by digest, salt and the whole normalised text; it spills when it must).
2. Salted: the digests of most rows (at most HOT of them, counted exactly from the
   digests alone) are salted by the map task's number modulo `salts`, so the survivors
   of a very large group meet in `salts` tasks. All others have one salt: without the
   HOT largest groups, none has more than 1 / HOT of the rows.
3. Global: the salted winners of a text, at most `salts` of them, are grouped by digest
   and whole text. Where there is one salt, the salted group is the whole group.

So a text crosses the network once for each map task that holds it, and no text twice
but those of salted winners. Grouping keys hold the text itself, so equal digests of
different texts never merge. Documents then take their group's values by the digest
alone, without their text; digests that turned out to stand for several texts (`clash`)
are grouped and joined by digest and text instead.

A row's rank is one decimal number, code points first and then the smaller id, so that
the winner is a plain maximum that hash aggregation keeps in place.

Defined cases: a null text is an empty one, and all empty texts (or those of white
space alone) are one group; ties in length go to the smaller id, a null id comes after
all others; of rows repeated whole (same id, equal texts, same length) one stays, any;
a text of any length is one value of its row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, documents

WHITE = " \t\n\x0b\f\r"
SALTS = 64
HOT = 1000
_STEP = "36893488147419103232BD"  # 2 ** 65, more than the number of ids
_TOP = "9223372036854775808BD"  # 2 ** 63


def rank(points: str, doc_id: str) -> Column:
    """Larger for more code points, then for the smaller id; a null id counts as the largest."""
    return F.expr(f"cast({points} as decimal(10,0)) * {_STEP} + coalesce({_TOP} - cast({doc_id} as decimal(20,0)), 0BD)")


def _winner(best: str) -> list[Column]:
    rest = f"({best} % {_STEP})"
    return [F.expr(f"case when {rest} > 0BD then cast({_TOP} - {rest} as bigint) end").alias("keep_id"),
            F.expr(f"cast({best} div {_STEP} as int)").alias("keep_points")]


def _placed(rows: DataFrame, winners: DataFrame, on: list[str], scratch: Scratch) -> DataFrame:
    """Every row with its group's values; `kept` holds for exactly one row of a group."""
    same = [*on, "points"]
    again = scratch.keep(rows.groupBy("doc_id", *same).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    found = rows.join(winners, on)
    is_best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    if again.isEmpty():
        found = found.withColumn("kept", is_best)
    else:
        other = again.select(F.col("doc_id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in same], "first")
        match = F.col("doc_id").eqNullSafe(F.col("id2"))
        for c in same:
            match = match & (F.col(c) == F.col(f"{c}2"))
        found = found.join(other, match, "left").withColumn("kept", is_best & (F.coalesce("first", "row") == F.col("row")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = lambda sha: sha, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; `digest` makes the grouping digest of the SHA-256."""
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(text, WHITE, "").alias("norm"), F.char_length(text).alias("points"))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("digest", digest(F.col("text_sha256")))

    keys = scratch.keep(rows.select("doc_id", "points", "text_sha256", "digest", F.monotonically_increasing_id().alias("row")))
    counts = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = F.col("digest").isin([r.digest for r in counts.orderBy(F.desc("n"), "digest").limit(HOT).collect()])

    salt = F.when(hot, F.spark_partition_id() % salts).otherwise(0)
    local = rows.select("digest", salt.alias("salt"), "norm", rank("points", "doc_id").alias("best"))
    salted = local.groupBy("digest", "salt", "norm").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    salted = scratch.keep(salted.select("digest", F.when(hot, F.col("norm")).alias("norm"), hot.alias("hot"), "best", "n"))
    spread = salted.where("hot").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    merged = scratch.keep(salted.where("not hot").select("digest", "best", "n").union(spread.select("digest", "best", "n")))
    scratch.drop(salted)
    clash = scratch.keep(merged.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))
    values = [*_winner("best"), F.col("n").alias("group_size")]
    winners = merged.select("digest", *values)
    if clash.isEmpty():
        return _placed(keys, winners, ["digest"], scratch)
    out = _placed(keys.join(clash, "digest", "left_anti"), winners.join(clash, "digest", "left_anti"), ["digest"], scratch)
    odd = scratch.keep(rows.join(clash, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    texts = odd.groupBy("digest", "norm").agg(F.max(rank("points", "doc_id")).alias("best"), F.count(F.lit(1)).alias("n")).select("digest", "norm", *values)
    return out.union(_placed(odd, texts, ["digest", "norm"], scratch))


def unique_documents(docs: DataFrame) -> DataFrame:
    """The input's rows that stay, all columns; rows repeated whole give one."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").cast("long").alias("id"),
                       F.sha2(F.translate(text, WHITE, ""), 256).alias("sha"), F.char_length(text).alias("points"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")))
    return found.groupBy("id", "sha").agg(F.max_by("whole", "points").alias("whole")).select("whole.*")


def query(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS place
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""
