"""Report queries over `issues` (L1-L13) and feedback aggregates (K3-K7, M4, M5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslint import config as C
from corpuslint.functions.columns import agent_of, is_test_file, severity_rank
from corpuslint.operators.positions import numbered

SORT_KEYS = ("severity", "path")


@dataclass(frozen=True)
class QueryOptions:
    """Filter / sort / page options, validated on construction."""

    severity_filter: tuple[str, ...] | None = None
    agent_filter: tuple[str, ...] | None = None
    path_filter: tuple[str, ...] | None = None
    sort_by: str | None = None
    offset: int | None = None
    limit: int | None = None
    include_parsed_files: bool = True
    include_project_graph: bool = True
    include_review_context: bool = True
    include_execution: bool = True
    include_feedback: bool = True

    def __post_init__(self):
        if self.offset is not None and self.offset < 0:
            raise ValueError("offset must be >= 0")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be >= 1")
        if self.sort_by is not None and self.sort_by not in SORT_KEYS:
            raise ValueError(f"sort_by must be one of {SORT_KEYS}")


def filter_issues(issues: DataFrame, opts: QueryOptions) -> DataFrame:
    """L1-L3: IN-list filters (an empty or missing list means no filter)."""
    out = issues
    if opts.severity_filter:
        out = out.filter(F.col("severity").isin(*opts.severity_filter))
    if opts.agent_filter:
        out = out.filter(agent_of(F.col("rule_id")).isin(*opts.agent_filter))
    if opts.path_filter:
        out = out.filter(F.col("path").isin(*opts.path_filter))
    return out


def sort_columns(opts: QueryOptions, tie: str = "seq") -> list:
    """The stable sort keys; the original order (``seq``) breaks ties."""
    line0 = F.coalesce(F.col("line"), F.lit(0))
    if opts.sort_by == "severity":
        keys = [severity_rank(F.col("severity")), F.col("path"), line0]
    elif opts.sort_by == "path":
        keys = [F.col("path"), line0, F.col("rule_id")]
    else:
        keys = []
    return keys + [F.col(tie)]


def query_issues(issues: DataFrame, opts: QueryOptions, tie: str = "seq") -> DataFrame:
    """L1-L8 per repo: filter, order, then the page [offset, offset+limit).

    The page is a ranking-window range, so with a limit Catalyst keeps only the
    top rows per repo on the map side (WindowGroupLimit) before the shuffle.
    With a sort but no limit every row from the offset on is kept and `page_pos` is
    its position, numbered over ranges of rows (which starts a job here).
    """
    out = filter_issues(issues, opts)
    start = opts.offset or 0
    if opts.limit is None and start == 0 and opts.sort_by is None:
        return out
    order = sort_columns(opts, tie)
    if opts.limit is None:
        return numbered(out, "repo", order, "page_pos").filter(F.col("page_pos") > start)
    ranked = out.withColumn("page_pos", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
    return ranked.filter((F.col("page_pos") > start) & (F.col("page_pos") <= start + opts.limit))


def summary_counts(issues: DataFrame) -> DataFrame:
    """L10 in one pass: GROUPING SETS ((repo, severity), (repo, agent), (repo)).

    Rows: repo, dimension ('total' | 'severity' | 'agent'), key, n.
    """
    with_agent = issues.withColumn("agent_key", agent_of(F.col("rule_id")))
    g = with_agent.groupingSets([["repo", "severity"], ["repo", "agent_key"], ["repo"]], "repo", "severity", "agent_key")
    agg = g.agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    # grouping_id bits follow (repo, severity, agent_key): 1 = agent rolled up, 2 = severity rolled up.
    return agg.select(
        "repo",
        F.when(F.col("gid") == 1, F.lit("severity")).when(F.col("gid") == 2, F.lit("agent"))
         .otherwise(F.lit("total")).alias("dimension"),
        F.when(F.col("gid") == 1, F.col("severity")).when(F.col("gid") == 2, F.col("agent_key"))
         .otherwise(F.lit("")).alias("key"),
        F.col("n").cast("bigint").alias("n"),
    )


def summary_record(issues: DataFrame, parsed: DataFrame, targets: DataFrame, repos: DataFrame) -> DataFrame:
    """L10/L11 as one row per repo with key-sorted count maps."""
    sev = issues.groupBy("repo", "severity").agg(F.count("*").alias("n")).groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"),
        F.sum("n").alias("total_issues"))
    ag = issues.groupBy("repo", agent_of(F.col("rule_id")).alias("agent")).agg(F.count("*").alias("n")).groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "n")))).alias("agent_counts"))
    files = parsed.groupBy("repo").agg(F.count("*").alias("total_files_parsed"))
    tg = targets.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.split("path", "/"), "path"))),
                                                 lambda x: x["path"]).alias("target_files"))
    empty_map = F.expr("cast(map() as map<string,bigint>)")
    return (repos.join(sev, ["repo"], "left").join(ag, ["repo"], "left").join(files, ["repo"], "left")
            .join(tg, ["repo"], "left").select(
                "repo", F.coalesce("total_issues", F.lit(0)).cast("bigint").alias("total_issues"),
                F.coalesce("total_files_parsed", F.lit(0)).cast("bigint").alias("total_files_parsed"),
                F.coalesce("target_files", F.expr("cast(array() as array<string>)")).alias("target_files"),
                F.coalesce("severity_counts", empty_map).alias("severity_counts"),
                F.coalesce("agent_counts", empty_map).alias("agent_counts")))


def issue_counts_by_file(issues: DataFrame) -> DataFrame:
    """K3."""
    return issues.groupBy("repo", "path").agg(F.count("*").cast("bigint").alias("n"))


def issue_counts_by_agent(raw_issues: DataFrame) -> DataFrame:
    """K4 (counted on the issues before new-issue filtering)."""
    return raw_issues.groupBy("repo", "agent").agg(F.count("*").cast("bigint").alias("n"))


def structure_findings(issues: DataFrame) -> DataFrame:
    """K5: titles of structure issues, in issue order."""
    s = issues.filter(F.col("rule_id").startswith("structure."))
    return s.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))),
                                             lambda x: x["title"]).alias("structure_findings"))


def verification(issue_counts: DataFrame, enabled: bool) -> DataFrame:
    """K6: skipped when disabled; failed with the issue count; otherwise passed."""
    n = F.coalesce(F.col("n_issues"), F.lit(0))
    if not enabled:
        return issue_counts.select("repo", F.lit(1).alias("attempt"), F.lit("self_verification").alias("action"),
                                   F.lit("skipped").alias("result"), F.lit("self_verification_disabled").alias("detail"))
    return issue_counts.select(
        "repo", F.lit(1).alias("attempt"), F.lit("review_output_validation").alias("action"),
        F.when(n > 0, F.lit("failed")).otherwise(F.lit("passed")).alias("result"),
        F.when(n > 0, F.concat(F.lit("issues_detected="), n)).otherwise(F.lit("no_issues_detected")).alias("detail"))


def test_summary(task_results: DataFrame) -> DataFrame:
    """First `test-result:status:detail` tag of the test family; default status not_run."""
    tags = task_results.filter(F.col("agent_name") == "test").select(
        "repo", "task_order", F.posexplode("evidence").alias("pos", "tag")).filter(
        F.col("tag").startswith(C.TEST_RESULT_PREFIX))
    first = tags.groupBy("repo").agg(F.min_by("tag", F.struct("task_order", "pos")).alias("tag"))
    parts = F.split(F.expr(f"substring(tag, {len(C.TEST_RESULT_PREFIX) + 1})"), ":", 2)
    found = first.select("repo", parts[0].alias("status"), F.coalesce(F.get(parts, 1), F.lit("")).alias("detail"))
    repos = task_results.select("repo").distinct()
    return repos.join(found, ["repo"], "left").select(
        "repo", F.coalesce("status", F.lit("not_run")).alias("status"), "detail")


def family_reports(issues: DataFrame, repos: DataFrame, families: tuple[str, ...], evidence: DataFrame | None = None) -> DataFrame:
    """M4: one row per (repo, family): issue count and roll-up severity, with the evidence rows of
    ``family_evidence`` the tags of each family too (none: an empty list)."""
    grid = repos.select("repo", F.explode(F.array(*[F.lit(f) for f in families])).alias("agent"))
    counts = issues.groupBy("repo", "agent").agg(F.count("*").alias("n"))
    sev_map = F.create_map(*[x for k, v in C.FAMILY_ISSUE_SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    j = grid.join(counts, ["repo", "agent"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    out = j.select("repo", "agent", n.alias("issue_count"),
                   F.when(n > 0, sev_map[F.col("agent")]).otherwise(F.lit("info")).alias("severity"))
    if evidence is None:
        return out
    return out.join(evidence, ["repo", "agent"], "left").withColumn(
        "evidence", F.coalesce("evidence", F.expr("cast(array() as array<string>)")))


def family_evidence(t) -> DataFrame:
    """F8, G10, H5, I4, J: (repo, agent, evidence) of the active families, one row each.

    Every tag is a count per repository of a table that the review has anyway; the counts
    combine map-side and meet at one row per repository.
    """
    count = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    tests = t.file_contexts.filter(is_test_file(F.col("path")))
    j = t.repos.join(t.budget.select("repo", "estimated_tokens"), ["repo"], "left")
    for df, name in ((t.key_files, "key_files"), (t.focus, "focus_paths"), (t.highlighted, "highlighted_paths"),
                     (t.changes.filter("status = 'changed'"), "changed_files"), (tests, "test_files")):
        j = j.join(count(df, name), ["repo"], "left")

    def tag(name: str) -> Column:
        return F.concat(F.lit(f"{name}="), F.coalesce(F.col(name), F.lit(0)).cast("string"))

    found = F.when(F.coalesce(F.col("test_files"), F.lit(0)) > 0, "True").otherwise("False")
    tags = {"structure": [tag("key_files"), tag("focus_paths")], "security": [tag("changed_files")], "style": [tag("highlighted_paths")],
            "performance": [tag("estimated_tokens")], "test": [F.concat(F.lit("has_test_file="), found), tag("test_files")]}
    rows = [F.struct(F.lit(f).alias("agent"), F.array(*tags[f]).alias("evidence")) for f in t.cfg.active_families if f in tags]
    return j.select("repo", F.explode(F.array(*rows)).alias("r")).select("repo", "r.agent", "r.evidence")


def execution_rollup(task_results: DataFrame) -> DataFrame:
    """M5: completed / failed counts and progress = done / total (1.0 without tasks).

    Where the results name their tasks (``task_id``, ``task_order``), the completed and the failed ones
    are listed in the order they ended; a run has a task per family.
    """
    done = F.col("status").isin("completed", "failed")
    lists = []
    if "task_id" in task_results.columns:
        lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("task_order", "task_id")))),
                             lambda x: x["task_id"]).alias(name)
                 for status, name in (("completed", "completed_order"), ("failed", "failed_tasks"))]
    agg = task_results.groupBy("repo").agg(
        F.count("*").cast("bigint").alias("total"),
        F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).cast("bigint").alias("completed"),
        F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).cast("bigint").alias("failed"),
        F.sum(F.when(done, 1).otherwise(0)).cast("bigint").alias("done"),
        F.sum(F.col("degraded").cast("int")).cast("bigint").alias("degraded"),
        *lists,
    )
    return agg.withColumn("progress", F.when(F.col("total") == 0, F.lit(1.0))
                          .otherwise(F.col("done").cast("double") / F.col("total")))


def family_tasks(t) -> DataFrame:
    """The run's tasks: one completed task per repository and active family, with its evidence."""
    families = sorted(t.cfg.active_families, key=lambda f: C.FAMILY_RANK.get(f, len(C.FAMILY_RANK)))
    tasks = F.array(*[F.struct(F.lit(i).alias("task_order"), F.lit(f).alias("agent")) for i, f in enumerate(families)])
    grid = t.repos.select("repo", F.explode(tasks).alias("x")).select("repo", "x.*")
    none = F.expr("cast(array() as array<string>)")
    return grid.join(family_evidence(t), ["repo", "agent"], "left").select(
        "repo", F.col("agent").alias("task_id"), F.col("agent").alias("agent_name"), "task_order", F.lit("completed").alias("status"),
        F.coalesce("evidence", none).alias("evidence"), F.lit(False).alias("degraded"))


def execution_record(t, task_results: DataFrame | None = None) -> DataFrame:
    """M5 as one row per repo: ordered completed and failed tasks, all task results, progress.

    Without task results of its own a run has those of its families. A repository
    without tasks has empty lists and progress 1.
    """
    tasks = family_tasks(t) if task_results is None else task_results
    result = F.struct("task_id", "agent_name", "status", "evidence", "degraded")
    listed = tasks.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("task_order", "task_id", result.alias("r")))),
                                                   lambda x: x["r"]).alias("task_results"))
    roll = execution_rollup(tasks).select("repo", "completed_order", "failed_tasks", "progress")
    j = t.repos.select("repo").join(roll, ["repo"], "left").join(listed, ["repo"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(j.schema[c].dataType)).alias(c)
    return j.select("repo", empty("completed_order"), empty("failed_tasks"), empty("task_results"),
                    F.coalesce("progress", F.lit(1.0)).alias("progress"))


def run_metadata(t) -> DataFrame:
    """Per repo, files scanned (accepted + skipped), parsed and failed."""
    scanned = t.decisions.groupBy("repo").agg(F.count("*").alias("total_files_scanned"))
    parsed = t.parsed.groupBy("repo").agg(F.count("*").alias("total_files_parsed"))
    failed = t.failed.groupBy("repo").agg(F.count("*").alias("total_failed_files"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (t.repos.join(scanned, ["repo"], "left").join(parsed, ["repo"], "left").join(failed, ["repo"], "left")
            .select("repo", z("total_files_scanned"), z("total_files_parsed"), z("total_failed_files"),
                    F.lit(",".join(sorted(t.cfg.active_families, key=C.FAMILY_RANK.get))).alias("executed_agents")))


def feedback_record(t, task_results: DataFrame | None = None) -> DataFrame:
    """K7: one feedback row per repo (targets, counts by file and by family, structure findings, test
    summary of the given task results, verification)."""
    issues, raw = t.issues(), t.raw_issues()
    targets = t.targets.groupBy("repo").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.split("path", "/").alias("k"), F.col("path").alias("p")))),
        lambda x: x["p"]).alias("target_file_paths"))
    by_file = issue_counts_by_file(issues).groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "n")))).alias("issue_count_by_file"))
    by_agent = issue_counts_by_agent(raw).groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "n")))).alias("agent_issue_counts"))
    n_issues = issues.groupBy("repo").agg(F.count("*").alias("n_issues"))
    ver = verification(t.repos.join(n_issues, ["repo"], "left"), t.cfg.self_verification_enabled)
    ver = ver.groupBy("repo").agg(F.collect_list(F.struct("attempt", "action", "result", "detail")).alias(
        "verification_attempts"))
    not_run = F.create_map(F.lit("status"), F.lit("not_run"))
    if task_results is None:
        tests = t.repos.select("repo", not_run.alias("test_summary"))
    else:
        # only a tag has a detail, an empty one included
        tagged = F.create_map(F.lit("status"), F.col("status"), F.lit("detail"), F.col("detail"))
        tests = test_summary(task_results).select(
            "repo", F.when(F.col("detail").isNull(), not_run).otherwise(tagged).alias("test_summary"))
    return (t.repos.join(targets, ["repo"], "left").join(by_file, ["repo"], "left").join(by_agent, ["repo"], "left")
            .join(structure_findings(issues), ["repo"], "left").join(ver, ["repo"], "left")
            .join(tests, ["repo"], "left").withColumn("test_summary", F.coalesce("test_summary", not_run)))
