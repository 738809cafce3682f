"""Review context (D1-D9) and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslint import config as C
from corpuslint.config import Settings
from corpuslint.functions.columns import basename, fingerprint, path_key


def structure_summary(parsed: DataFrame) -> DataFrame:
    """D2 as rows: repo, language, file_count, total_files."""
    per_lang = parsed.groupBy("repo", "language").agg(F.count("*").alias("file_count"))
    total = F.sum("file_count").over(Window.partitionBy("repo"))
    return per_lang.withColumn("total_files", total.cast("bigint"))


def language_distribution_map(parsed: DataFrame) -> DataFrame:
    """D2 as one row per repo with a key-sorted MAP<STRING,BIGINT>."""
    per_lang = parsed.groupBy("repo", "language").agg(F.count("*").alias("n"))
    return per_lang.groupBy("repo").agg(
        F.sum("n").alias("total_files"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("language_distribution"))


def first_paths(df: DataFrame, n: int, name: str = "rank") -> DataFrame:
    """D3: first ``n`` paths per repo in path order (a ranking-window limit)."""
    w = Window.partitionBy("repo").orderBy(path_key("path"))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def degrees(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """+1 for the source of every edge, +1 for the target of a resolved edge; over `tasks` tasks if given."""
    src = edges.select("repo", F.col("source").alias("path"))
    dst = edges.filter("resolved").select("repo", F.col("target").alias("path"))
    ends = src.unionByName(dst)
    if tasks:
        ends = ends.repartition(tasks, "repo", "path")
    return ends.groupBy("repo", "path").agg(F.count("*").alias("degree"))


def key_file_scores(parsed: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """score = degree + 5 entry point + 4 config + 1 top level; reasons in fixed order."""
    name = basename(F.col("path"))
    deg = F.coalesce(F.col("degree"), F.lit(0))
    entry = name.isin(*C.ENTRYPOINT_NAMES)
    conf = name.isin(*C.CONFIG_NAMES)
    top = ~F.col("path").contains("/")
    scored = parsed.select("repo", "path").join(degrees(edges, tasks), ["repo", "path"], "left").select(
        "repo", "path",
        (deg + F.when(entry, 5).otherwise(0) + F.when(conf, 4).otherwise(0) + F.when(top, 1).otherwise(0))
        .cast("int").alias("score"),
        F.concat_ws(",", F.when(entry, F.lit("entrypoint")), F.when(conf, F.lit("config")),
                    F.when(top, F.lit("top-level")), F.when(deg > 0, F.lit("high-degree"))).alias("reason"),
    )
    return scored.filter(F.col("score") > 0).withColumn(
        "reason", F.when(F.col("reason") == "", F.lit("scored")).otherwise(F.col("reason")))


def key_files(parsed: DataFrame, edges: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """Top-k by (score desc, path asc) per repo."""
    w = Window.partitionBy("repo").orderBy(F.col("score").desc(), F.col("path"))
    return key_file_scores(parsed, edges, tasks).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def focus_paths(edges: DataFrame, keys: DataFrame, edge_cap: int) -> DataFrame:
    """Paths of the first ``edge_cap`` edges touching a key file, first-appearance order."""
    w = Window.partitionBy("repo").orderBy(path_key("source"), F.col("module"))
    first = edges.withColumn("edge_rank", F.row_number().over(w)).filter(F.col("edge_rank") <= edge_cap)
    key_sets = keys.groupBy("repo").agg(F.collect_set("path").alias("key_paths"))  # <= k paths per repo
    touching = first.join(key_sets, ["repo"]).filter(
        F.array_contains("key_paths", F.col("source")) | F.array_contains("key_paths", F.col("target")))
    ends = touching.select("repo", "edge_rank", F.posexplode(F.array("source", "target")).alias("end", "path"))
    firsts = ends.groupBy("repo", "path").agg(F.min(F.struct("edge_rank", "end")).alias("first"))
    w2 = Window.partitionBy("repo").orderBy("first")
    return firsts.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= edge_cap).select(
        "repo", "path", "rank")


def budget(repos: DataFrame, parsed: DataFrame, highlighted: DataFrame, keys: DataFrame, focus: DataFrame,
           cfg: Settings) -> DataFrame:
    """Estimated tokens vs the limit per repo (computed from unpruned inputs)."""
    files = parsed.groupBy("repo").agg(F.count("*").alias("file_count"),
                                      F.min_by("path", path_key("path")).alias("first_path"))
    h = highlighted.groupBy("repo").agg(F.sum(F.length("path")).alias("h"))
    kf = keys.groupBy("repo").agg(F.sum(F.length("path") + F.length("reason")).alias("kf"))
    fc = focus.groupBy("repo").agg(F.sum(F.length("path")).alias("fc"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    j = repos.join(files, ["repo"], "left").join(h, ["repo"], "left").join(kf, ["repo"], "left").join(fc, ["repo"], "left")
    est = z("h") + z("kf") + z("fc") + z("file_count") * 40
    limit = F.lit(cfg.structure_summary_cap + cfg.key_files_token_cap + cfg.dependency_token_cap) + \
        z("file_count") * cfg.per_file_issue_budget
    return j.select(
        "repo", "first_path",
        F.lit(cfg.tokenizer_name).alias("tokenizer_name"),
        est.alias("estimated_tokens"),
        F.lit(cfg.structure_summary_cap).alias("structure_summary_cap"),
        F.lit(cfg.key_files_token_cap).alias("key_files_token_cap"),
        F.lit(cfg.dependency_token_cap).alias("dependency_token_cap"),
        F.lit(cfg.per_file_issue_budget).alias("per_file_issue_budget"),
        limit.alias("budget_limit"),
        (est <= limit).alias("within_budget"),
        F.when(est > limit, F.lit(C.BUDGET_REASON)).alias("truncation_reason"),
    )


def file_changes(parsed: DataFrame, history: DataFrame | None) -> DataFrame:
    """Changed if the file has no history row or its hash differs."""
    base = parsed.select("repo", "path", "content_hash")
    if history is None:
        return base.select("repo", "path", F.lit("changed").alias("status"))
    h = history.select("repo", "path", F.col("content_hash").alias("h_hash"))
    j = base.join(h, ["repo", "path"], "left")
    return j.select("repo", "path",
                    F.when(F.col("h_hash").eqNullSafe(F.col("content_hash")) & F.col("h_hash").isNotNull(),
                           F.lit("unchanged")).otherwise(F.lit("changed")).alias("status"))


def target_files(changes: DataFrame, cfg: Settings) -> DataFrame:
    """The changed files if the switch is on and any file changed, else every file."""
    if not cfg.review_changed_files_only:
        return changes.select("repo", "path")
    per_repo = changes.groupBy("repo").agg(F.max((F.col("status") == "changed").cast("int")).alias("any_changed"))
    return (changes.join(per_repo, ["repo"])
                   .filter((F.col("any_changed") == 0) | (F.col("status") == "changed"))
                   .select("repo", "path"))


def issue_fingerprints(issues: DataFrame) -> DataFrame:
    return issues.withColumn("fingerprint", fingerprint(F.col("path"), F.col("title")))


def new_issues(raw: DataFrame, history: DataFrame | None, cfg: Settings) -> DataFrame:
    """K1: drop issues whose (path, fingerprint) the previous run already stored."""
    if not cfg.report_only_new_issues or history is None:
        return raw
    seen = history.select("repo", "path", F.explode("issue_fingerprints").alias("fingerprint")).distinct()
    return issue_fingerprints(raw).join(seen, ["repo", "path", "fingerprint"], "left_anti").drop("fingerprint")


def issues_per_file(issues: DataFrame) -> DataFrame:
    """K2: issues and suggestion titles per file, in issue order."""
    ordered = issues.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct(
        F.col("seq").alias("seq"), F.struct(*[c for c in issues.columns if c not in ("repo", "seq")]).alias("issue")))).alias("items"))
    return ordered.select("repo", "path",
                          F.transform("items", lambda x: x["issue"]).alias("issues"),
                          F.transform("items", lambda x: x["issue"]["title"]).alias("suggestions"))


def with_issues(file_contexts: DataFrame, issues: DataFrame, include_issue_lists: bool = True) -> DataFrame:
    """K2: file contexts with the issues and suggestion titles of each file; a file without any has empty
    lists, as all issue lists are where they are not wanted (suggestions stay)."""
    per_file = issues_per_file(issues)
    j = file_contexts.join(per_file, ["repo", "path"], "left")
    empty = {c: F.array().cast(per_file.schema[c].dataType) for c in ("issues", "suggestions")}
    lists = F.coalesce("issues", empty["issues"]) if include_issue_lists else empty["issues"]
    return j.withColumn("issues", lists).withColumn("suggestions", F.coalesce("suggestions", empty["suggestions"]))


def next_history(parsed: DataFrame, issues: DataFrame, history: DataFrame | None, cfg: Settings) -> DataFrame:
    """History rows of the current files; fingerprints from the reported issues.

    mode 'replace' stores only the new fingerprints (a reported issue is stored,
    so the next run suppresses it, and the run after that reports it again);
    mode 'union' also keeps the old fingerprints of files still present.
    """
    fps = issue_fingerprints(issues).groupBy("repo", "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "fingerprint"))), lambda x: x["fingerprint"])
        .alias("new_fps"))
    base = parsed.select("repo", "path", "content_hash").join(fps, ["repo", "path"], "left")
    fp = F.coalesce(F.col("new_fps"), F.expr("cast(array() as array<string>)"))
    if cfg.history_mode == "union" and history is not None:
        old = history.select("repo", "path", F.col("issue_fingerprints").alias("old_fps"))
        base = base.join(old, ["repo", "path"], "left")
        fp = F.array_distinct(F.concat(F.coalesce("old_fps", F.expr("cast(array() as array<string>)")), fp))
    out = base.select("repo", "path", "content_hash", fp.alias("issue_fingerprints"))
    if cfg.history_max_entries is None:
        return out
    return first_paths(out, cfg.history_max_entries, "rank").drop("rank")
