"""Structure rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.config import CROSS_FILE_HEURISTIC, Settings
from corpuslint.functions.columns import path_key
from corpuslint.operators.containment import points_inside
from corpuslint.operators.graph import cycle_rows
from corpuslint.operators.issues import catalogue_lookup, make_issues, seq

BRANCH_NODES = ("If", "For", "While", "Try", "Match")


def explode_symbols(parsed: DataFrame, kind: str) -> DataFrame:
    """One row per function/class symbol with its position in the file's sorted list."""
    col = "functions" if kind == "function" else "classes"
    return parsed.select("repo", "path", "language", F.posexplode(col).alias("pos", "sym")).select(
        "repo", "path", "language", "pos", "sym.*")


def circular_dependency(t, cfg: Settings) -> DataFrame:
    if "cycles" not in t.extra:  # iterative job: run once per analysis, reuse the written result
        t.extra["cycles"] = cycle_rows(t.parsed, t.edges)
    cyc = t.extra["cycles"]
    return make_issues(cyc, "structure.circular-dependency", path=F.col("path"), line=None,
                       evidence=F.array("evidence"), order=seq("structure", 0, F.col("path")))


def large_function(t, cfg: Settings) -> DataFrame:
    fn = explode_symbols(t.parsed, "function").withColumn("span", F.col("line_end") - F.col("line_start") + 1)
    hit = fn.filter(F.col("span") > cfg.structure_max_function_lines)
    return make_issues(hit, "structure.large-function", path=F.col("path"), line=F.col("line_start"),
                       evidence=F.array(F.concat(F.lit("function="), "name"), F.concat(F.lit("line_span="), "span")),
                       order=seq("structure", 1, F.col("path"), F.col("pos")))


def complex_function(t, cfg: Settings) -> DataFrame:
    facts = t.facts
    fn = facts.filter(F.col("node") == "FunctionDef").select(
        "repo", "path", "pre", "last", F.col("bfs").alias("f_bfs"), F.col("line").alias("f_line"), F.col("name").alias("f_name"))
    branches = facts.filter(F.col("node").isin(*BRANCH_NODES)).select("repo", "path", "pre")
    hit = points_inside(fn, branches, ["f_bfs", "f_line", "f_name"]).filter(F.col("n") > cfg.structure_max_branch_nodes)
    return make_issues(hit, "structure.complex-function", path=F.col("path"), line=F.col("f_line"),
                       evidence=F.array(F.concat(F.lit("function="), "f_name"), F.concat(F.lit("branch_nodes="), "n")),
                       order=seq("structure", 2, F.col("path"), F.col("f_bfs")))


def unused_import(t, cfg: Settings) -> DataFrame:
    facts = t.facts
    aliases = facts.filter(F.col("node").isin("Import", "ImportFrom")).groupBy("repo", "path", "name").agg(
        F.max_by("line", "bfs").alias("line"), F.min(F.struct("bfs", "idx")).alias("first"))
    names = facts.filter(F.col("node") == "Name").select("repo", "path", "name")
    hit = aliases.join(names, ["repo", "path", "name"], "left_anti")
    return make_issues(hit, "structure.unused-import", path=F.col("path"), line=F.col("line"),
                       evidence=F.array("name"),
                       order=seq("structure", 3, F.col("path"), F.col("first.bfs"), F.col("first.idx")))


def unused_symbols(t, cfg: Settings) -> DataFrame:
    """a symbol no *other* Python file names (as a Name or an import binding).

    One aggregate per (repo, name) replaces the files x symbols loop: a name is
    used elsewhere iff it occurs in two files, or in one file that is not the
    defining one. Partial aggregation runs map-side, so a hot name costs one row
    per map task before the shuffle.
    """
    facts = t.facts
    usage = (facts.filter(F.col("node").isin("Name", "Import", "ImportFrom"))
                  .select("repo", "path", "name").distinct()
                  .groupBy("repo", "name").agg(F.count("*").alias("n_files"),
                                               F.min("path").alias("only_path")))
    local = facts.filter(F.col("node") == "Name").select("repo", "path", "name", F.lit(True).alias("local_use"))
    file_counts = t.parsed.groupBy("repo").agg(F.count("*").alias("repo_files"))
    py = t.parsed.filter(F.col("language") == "python")
    fns = explode_symbols(py, "function").filter(
        ~F.col("name").startswith("test_") & (F.col("name") != "run")).withColumn("kind_rank", F.lit(0))
    cls = explode_symbols(py, "class").withColumn("kind_rank", F.lit(1))
    syms = fns.unionByName(cls)
    j = (syms.join(usage, ["repo", "name"], "left")
             .join(local, ["repo", "path", "name"], "left")
             .join(file_counts, ["repo"], "left"))
    used_elsewhere = (F.col("n_files") >= 2) | ((F.col("n_files") == 1) & (F.col("only_path") != F.col("path")))
    exempt = (F.col("repo_files") == 1) & F.coalesce(F.col("local_use"), F.lit(False))
    hit = j.filter(~F.coalesce(used_elsewhere, F.lit(False)) & ~exempt)
    # One select for both rules, so the joins above are made once.
    rule = F.when(F.col("kind_rank") == 0, "structure.unused-function").otherwise("structure.unused-class")
    return hit.withColumn("rule", rule).select(
        "repo", F.lit("structure").alias("agent"), F.col("rule").alias("rule_id"),
        catalogue_lookup(F.col("rule"), 0).alias("title"), catalogue_lookup(F.col("rule"), 1).alias("description"),
        catalogue_lookup(F.col("rule"), 2).alias("severity"), "path", F.col("line_start").cast("int").alias("line"),
        catalogue_lookup(F.col("rule"), 3).cast("double").alias("confidence"), F.array("name", F.lit(CROSS_FILE_HEURISTIC)).alias("evidence"),
        seq("structure", 4, F.col("path"), F.col("kind_rank"), F.col("pos")).alias("seq"))


def large_review_scope(t, cfg: Settings) -> DataFrame:
    agg = t.parsed.groupBy("repo").agg(F.count("*").alias("n"),
                                       F.min_by("path", path_key("path")).alias("first"))
    hit = agg.filter(F.col("n") > cfg.large_scope_files)
    return make_issues(hit, "structure.large-review-scope", path=F.col("first"), line=None,
                       evidence=F.array(F.concat(F.lit("file_count="), "n")),
                       order=seq("structure", 5, F.col("first")))


RULES = [
    (("structure.circular-dependency",), circular_dependency),
    (("structure.large-function",), large_function),
    (("structure.complex-function",), complex_function),
    (("structure.unused-import",), unused_import),
    (("structure.unused-function", "structure.unused-class"), unused_symbols),
    (("structure.large-review-scope",), large_review_scope),
]
