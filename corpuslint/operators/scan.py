"""Admission of files (A2-A10): history-file drop, globs, size cap, count/byte budget.

Everything but the budget is a per-row predicate that stays in Catalyst. The budget is
decided by ``operators.budget`` on ``(repo, path, size)`` alone - content never moves -
and only for repositories that overflow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.config import SKIP_REASON, Settings
from corpuslint.functions.columns import language_of, matches_globs
from corpuslint.operators.budget import budget_decisions


def _row_rule(cfg: Settings):
    path, size = F.col("path"), F.col("size_bytes")
    rule = F.when(matches_globs(path, cfg.exclude_globs), F.lit("exclude")).when(
        ~matches_globs(path, cfg.include_globs), F.lit("include"))
    if cfg.max_file_bytes is not None:
        rule = rule.when(size > F.lit(cfg.max_file_bytes), F.lit("max_file_bytes"))
    if cfg.max_file_bytes is not None or cfg.max_total_bytes is not None:  # a byte cap cannot be held against no size
        rule = rule.when(size.isNull(), F.lit("size_unknown"))
    return rule


def admit(files: DataFrame, cfg: Settings) -> DataFrame:
    """Decision table: repo, path, size_bytes, language, skip_rule (null = accepted)."""
    base = files.select("repo", "path", F.col("size_bytes").cast("bigint").alias("size_bytes"))
    base = base.filter(F.col("path") != F.lit(cfg.history_file_path))
    path = F.col("path")
    rule = _row_rule(cfg)
    decided = base.withColumn("skip_rule", rule)
    if has_budget(cfg):
        early = decided.filter(F.col("skip_rule").isNotNull())
        candidates = decided.filter(F.col("skip_rule").isNull()).select("repo", "path", "size_bytes")
        # A repo whose admissible files fit entirely accepts them all (sizes are >= 0, so every
        # prefix fits too): only overflowing repos need the phases. Totals combine map-side.
        totals = candidates.groupBy("repo").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
        fits = F.lit(True)
        if cfg.max_files is not None:
            fits = fits & (F.col("n") <= cfg.max_files)
        if cfg.max_total_bytes is not None:
            fits = fits & (F.col("b") <= cfg.max_total_bytes)
        fitting = totals.filter(fits).select("repo")
        whole = candidates.join(fitting, ["repo"], "left_semi").withColumn("skip_rule", F.lit(None).cast("string"))
        overflowing = candidates.join(fitting, ["repo"], "left_anti")
        decided = early.unionByName(whole).unionByName(budget_decisions(overflowing, cfg.max_files, cfg.max_total_bytes))
    return decided.withColumn("language", language_of(path))


def has_budget(cfg: Settings) -> bool:
    return cfg.max_files is not None or cfg.max_total_bytes is not None


def accepted_files(files: DataFrame, decisions: DataFrame, cfg: Settings) -> DataFrame:
    """Accepted rows with their content.

    Without a count/byte budget every decision is a row predicate, so content
    never moves (narrow filter). A budget was decided on (path, size)
    alone and content is joined once to the accepted keys.
    """
    carried = ["content", *(c for c in ("read_error",) if c in files.columns)]
    if not has_budget(cfg):
        return (files.select("repo", "path", *carried, F.col("size_bytes").cast("bigint").alias("size_bytes"))
                .filter(F.col("path") != F.lit(cfg.history_file_path))
                .filter(_row_rule(cfg).isNull())
                .withColumn("language", language_of(F.col("path"))))
    ok = decisions.filter(F.col("skip_rule").isNull()).select("repo", "path", "language", "size_bytes")
    return files.select("repo", "path", *carried).join(ok, ["repo", "path"], "inner")


def skipped_files(decisions: DataFrame) -> DataFrame:
    """A10: every rejection is a failed row at stage `scan` (skip_rule names the rule)."""
    return decisions.filter(F.col("skip_rule").isNotNull()).select(
        "repo", "path", F.lit(SKIP_REASON).alias("reason"), F.lit("scan").alias("stage"), "skip_rule")
