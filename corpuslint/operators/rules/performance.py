"""Performance rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.operators.containment import enclosing
from corpuslint.operators.issues import make_issues, seq


def _loops(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("node").isin("For", "While")).select("repo", "path", "pre", "last", F.col("bfs").alias("l_bfs"))


def loop_io(t, cfg) -> DataFrame:
    """One issue per (enclosing loop, I/O call): nested loops report a call twice."""
    calls = t.facts.filter((F.col("node") == "Call") & F.col("call_name").isin(*C.LOOP_IO_CALLS)).select(
        "repo", "path", "pre", F.col("bfs").alias("c_bfs"), F.col("line").alias("c_line"), "call_name")
    pairs = enclosing(calls, _loops(t.facts), "l_bfs", ["c_bfs", "c_line", "call_name"])
    return make_issues(pairs, "performance.loop-io", path=F.col("path"), line=F.col("c_line"),
                       evidence=F.array("call_name"), order=seq("performance", 0, F.col("path"), F.col("l_bfs"), F.col("c_bfs")))


def repeated_len(t, cfg) -> DataFrame:
    lens = t.facts.filter((F.col("node") == "Call") & (F.col("name") == "len")).select(
        "repo", "path", "pre", F.col("bfs").alias("c_bfs"), F.col("line").alias("c_line"))
    pairs = enclosing(lens, _loops(t.facts), "l_bfs", ["c_bfs", "c_line"])
    agg = pairs.groupBy("repo", "path", "l_bfs").agg(F.count("*").alias("n"), F.min_by("c_line", "c_bfs").alias("line"))
    hit = agg.filter(F.col("n") >= 2)
    return make_issues(hit, "performance.repeated-len-call", path=F.col("path"), line=F.col("line"),
                       evidence=F.array(F.concat(F.lit("len_calls="), "n")),
                       order=seq("performance", 1, F.col("path"), F.col("l_bfs")))


def context_budget(t, cfg) -> DataFrame:
    over = t.budget.filter(~F.col("within_budget"))
    return make_issues(over, "performance.context-budget", path=F.coalesce(F.col("first_path"), F.lit(".")), line=None,
                       evidence=F.array(F.coalesce(F.col("truncation_reason"), F.lit("budget_exceeded"))),
                       order=seq("performance", 2, F.coalesce(F.col("first_path"), F.lit("."))))


RULES = [
    (("performance.loop-io",), loop_io),
    (("performance.repeated-len-call",), repeated_len),
    (("performance.context-budget",), context_budget),
]
