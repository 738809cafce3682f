"""Sinks (N1-N5): SARIF, JSON and Markdown reports, and the versioned history table.

Row-level outputs (one SARIF result or Markdown line per issue) are plain
DataFrames written in parallel, partitioned by repo. Whole documents per repo
are assembled with ``to_json``/``array_join`` over that repo's rows only.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.functions.columns import path_key, sarif_level
from corpuslint.operators import report as rep
from corpuslint.operators.issues import SEQ_TYPE, union_all
from corpuslint.session import delete_tables, write_table

TOOL_NAME = "corpuslint"


def sarif_results(issues: DataFrame) -> DataFrame:
    """One SARIF result per issue; `region` is empty when the line is null."""
    region = F.struct(F.col("line").alias("startLine"))  # to_json drops a null startLine: "region": {}
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("title").alias("text")).alias("message"),
        F.struct(F.col("confidence").alias("confidence"), F.col("severity").alias("severity")).alias("properties"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
                                  region.alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    return issues.select("repo", "seq", result.alias("result"))


def sarif_rules(issues: DataFrame) -> DataFrame:
    """Rule catalogue of a run, distinct by rule id, first issue wins."""
    first = issues.groupBy("repo", "rule_id").agg(
        F.min_by(F.struct("title", "description", "severity"), "seq").alias("r"), F.min("seq").alias("seq"))
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("r.title").alias("name"),
        F.struct(F.col("r.title").alias("text")).alias("shortDescription"),
        F.struct(F.col("r.description").alias("text")).alias("fullDescription"),
        F.concat(F.lit(C.SARIF_HELP_URI_PREFIX), F.col("rule_id")).alias("helpUri"),
        F.struct(F.col("r.severity").alias("severity")).alias("properties"),
    )
    return first.select("repo", "seq", rule.alias("rule"))


def sarif_documents(issues: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """SARIF 2.1.0 text per repo: repo, sarif. Of the given repos a clean one has an empty run."""
    res = sarif_results(issues).groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "result"))), lambda x: x["result"]).alias("results"))
    rules = sarif_rules(issues).groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "rule"))), lambda x: x["rule"]).alias("rules"))
    repos = issues.select("repo").distinct() if repos is None else repos.select("repo")
    j = repos.join(res, ["repo"], "left").join(rules, ["repo"], "left")
    doc = F.struct(
        F.lit(C.SARIF_SCHEMA).alias("$schema"), F.lit(C.SARIF_VERSION).alias("version"),
        F.array(F.struct(F.struct(F.struct(F.lit(TOOL_NAME).alias("name"), _or_empty(j, "rules")).alias("driver")).alias("tool"),
                         _or_empty(j, "results"))).alias("runs"))
    return j.select("repo", F.to_json(doc).alias("sarif"))


def _or_empty(df: DataFrame, name: str) -> Column:
    """An array column of ``df`` with an empty array in place of null."""
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)).alias(name)


def _listed(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """(repo, name): the values of each repo in order."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    return df.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))),
                                              lambda x: x["v"]).alias(name))


def json_reports(t, issues: DataFrame, opts=None, task_results: DataFrame | None = None) -> DataFrame:
    """One JSON document per repo; a section without rows is an empty array.

    The execution section lists the given task results, else the run's families; a summary has none.

    L9: sections switched off in ``opts`` are left out of the projection, so
    their branches are never computed.
    """
    opts = opts or rep.QueryOptions()
    metadata = rep.run_metadata(t).select("repo", F.struct(
        F.col("repo").alias("repo_path"), "total_files_scanned", "total_files_parsed", "total_failed_files",
        F.split("executed_agents", ",").alias("executed_agents")).alias("metadata"))
    failed = _listed(t.failed, [F.col("path")], F.struct("path", "reason", "stage"), "failed_files")
    listed = _listed(issues, [F.col("seq")], F.struct("rule_id", "title", "description", "severity", "path", "line",
                                                      "confidence", "evidence"), "issues")
    summary = rep.summary_record(issues, t.parsed, t.targets, t.repos).select("repo", F.struct(
        F.col("repo").alias("repo_path"), "total_issues", "total_files_parsed", "target_files", "severity_counts",
        "agent_counts").alias("summary"))
    j = t.repos.join(metadata, ["repo"], "left").join(failed, ["repo"], "left").join(listed, ["repo"], "left").join(
        summary, ["repo"], "left")
    fields = [F.col("metadata"), _or_empty(j, "failed_files"), _or_empty(j, "issues"), F.col("summary")]
    if opts.include_parsed_files:
        j = j.join(_listed(t.parsed, [path_key("path")], F.struct(
            "path", "language", "parse_mode", "size_bytes", "content_hash", "imports", "functions", "classes"),
            "parsed_files"), ["repo"], "left")
        fields.append(_or_empty(j, "parsed_files"))
    if opts.include_project_graph:
        j = j.join(_listed(t.parsed, [path_key("path")], F.col("path"), "nodes"), ["repo"], "left").join(
            _listed(t.edges, [path_key("source"), F.col("module")], F.struct(
                "source", "target", "edge_type", "resolution_confidence", "resolved"), "edges"), ["repo"], "left")
        fields.append(F.struct(_or_empty(j, "nodes"), _or_empty(j, "edges")).alias("project_graph"))
    if opts.include_review_context:
        j = j.join(_context_counts(t), ["repo"], "left").join(
            _listed(t.key_files, [F.col("rank")], F.struct("path", "score", "reason"), "key_files"), ["repo"], "left").join(
            _listed(t.changes.filter("status = 'changed'"), [path_key("path")], F.col("path"), "changed_files"), ["repo"], "left")
        fields.append(F.struct("total_files", "estimated_tokens", "within_budget", _or_empty(j, "key_files"),
                               _or_empty(j, "changed_files")).alias("review_context"))
    if opts.include_execution and not t.cfg.summary_only:
        run = rep.execution_record(t, task_results)
        j = j.join(run.select("repo", F.struct(*[c for c in run.columns if c != "repo"]).alias("execution")), ["repo"], "left")
        fields.append(F.col("execution"))
    if opts.include_feedback:
        fb = rep.feedback_record(t, task_results)
        j = j.join(fb.select("repo", F.struct(*[c for c in fb.columns if c != "repo"]).alias("feedback")), ["repo"], "left")
        fields.append(F.col("feedback"))
    return j.select("repo", F.to_json(F.struct(*fields)).alias("json"))


def _context_counts(t) -> DataFrame:
    """(repo, total_files, key_count, changed_count, estimated_tokens, within_budget)."""
    count = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    z = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return (t.budget.select("repo", "estimated_tokens", "within_budget").join(count(t.parsed, "total_files"), ["repo"], "left")
            .join(count(t.key_files, "key_count"), ["repo"], "left")
            .join(count(t.changes.filter("status = 'changed'"), "changed_count"), ["repo"], "left")
            .select("repo", z("total_files"), z("key_count"), z("changed_count"), "estimated_tokens", "within_budget"))


def markdown_lines(t, issues: DataFrame, opts=None, task_results: DataFrame | None = None) -> DataFrame:
    """N4 as rows: repo, pos, text; a report is its repo's lines in the order of `pos`.

    Every line is a row that is written in parallel. Sections without rows are left
    out, but for the parsed files and the edges. The sections of context, execution and
    feedback can be switched off in ``opts``; the lines of files and edges as well,
    whose headings stay.
    """
    opts = opts or rep.QueryOptions()

    def order(section: int, part: int, c: Column | None = None, d=0, f: Column | None = None, seq: Column | None = None) -> Column:
        none = F.expr("cast(array() as array<string>)")
        own = F.struct(F.lit(0), F.lit(0), c if c is not None else none, F.lit(d), F.lit(0), f if f is not None else F.lit(""))
        return F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"),
                        (seq if seq is not None else own).cast(SEQ_TYPE).alias("seq")).alias("pos")

    def several(df: DataFrame, section: int, part: int, *texts) -> list[DataFrame]:
        return [df.select("repo", order(section, part, d=i).alias("pos"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in text]).alias("text"))
                for i, text in enumerate(texts)]

    def heading(df: DataFrame, section: int, title: str) -> list[DataFrame]:
        return several(df.select("repo").distinct(), section, 0, ("",), (f"## {title}",), ("",))

    def body(df: DataFrame, pos: Column, *parts) -> DataFrame:
        return df.select("repo", pos, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]).alias("text"))

    meta, col = rep.run_metadata(t), F.col
    text = lambda name: F.col(name).cast("string")
    targets = _listed(t.targets, [path_key("path")], F.col("path"), "targets")
    feedback = t.repos.join(targets, ["repo"], "left").withColumn("names", F.coalesce(F.array_join("targets", ", "), F.lit("")))
    frames = several(meta, 1, 0, ("# Code Review Report",), ("",), ("- Repo: `", col("repo"), "`"),
                     ("- Parsed files: `", text("total_files_parsed"), "`"), ("- Failed files: `", text("total_failed_files"), "`"))
    frames += heading(t.repos, 2, "Parsed Files")
    if opts.include_parsed_files:
        frames.append(body(t.parsed, order(2, 1, path_key("path")), "- `", col("path"), "` (", col("language"), ", ", col("parse_mode"), ")"))
    frames += heading(t.repos, 3, "Dependency Edges")
    if opts.include_project_graph:
        frames.append(body(t.edges, order(3, 1, path_key("source"), f=col("module")), "- `", col("source"), "` -> `", col("target"),
                           "` confidence=", F.format_string("%.1f", "resolution_confidence")))
    if opts.include_review_context:
        frames += heading(t.repos, 4, "Review Context")
        frames += several(_context_counts(t), 4, 1, ("- Total files: `", text("total_files"), "`"), ("- Key files: `", text("key_count"), "`"),
                          ("- Changed files: `", text("changed_count"), "`"), ("- Estimated tokens: `", text("estimated_tokens"), "`"))
    if opts.include_execution and not t.cfg.summary_only:
        tasks = rep.execution_record(t, task_results)
        names = lambda c: F.array_join(c, ", ")
        frames += heading(t.repos, 5, "Execution")
        frames += several(tasks, 5, 1, ("- Progress: `", F.format_string("%.2f", "progress"), "`"),
                          ("- Completed tasks: `", names("completed_order"), "`"), ("- Failed tasks: `", names("failed_tasks"), "`"))
    if opts.include_feedback:
        frames += heading(t.repos, 6, "Feedback")
        frames += several(feedback, 6, 1, ("- Target files: `", col("names"), "`"), ("- Verification attempts: `1`",))
    frames += heading(issues, 7, "Issues")
    frames.append(body(issues, order(7, 1, seq=col("seq")), "- `", col("rule_id"), "` ", col("severity"), " `", col("path"), "` ", col("title")))
    frames += heading(t.failed, 8, "Failed Files")
    frames.append(body(t.failed, order(8, 1, path_key("path"), f=col("stage")), "- `", col("path"), "` [", col("stage"), "] ", col("reason")))
    return union_all(frames)


def markdown_documents(t, issues: DataFrame, opts=None, task_results: DataFrame | None = None) -> DataFrame:
    """Markdown report per repo, assembled from its lines."""
    lines = _listed(markdown_lines(t, issues, opts, task_results), [F.col("pos")], F.col("text"), "lines")
    return lines.select("repo", F.array_join("lines", "\n").alias("markdown"))


# ---------------------------------------------------------------- history

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _history_versions(spark: SparkSession, base: str) -> dict[int, bool]:
    """Version numbers that are taken, and whether each is complete."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return {}
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return {int(st.getPath().getName().split("=", 1)[1]): fs.exists(done(st.getPath(), "_SUCCESS"))
            for st in fs.listStatus(p) if st.isDirectory() and st.getPath().getName().startswith("version=")}


def latest_history_version(spark: SparkSession, base: str) -> int | None:
    return max((v for v, complete in _history_versions(spark, base).items() if complete), default=None)


def read_history(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    v = latest_history_version(spark, base) if version is None else version
    return None if v is None else spark.read.parquet(f"{base.rstrip('/')}/version={v}")


def merge_history(own: DataFrame, theirs: DataFrame, both: bool) -> DataFrame:
    """Rows of a run over the rows that stand: other repositories keep theirs, the run's own repositories
    have its files. `both`: of a file in the two, all fingerprints stay, those that stand first."""
    others = theirs.join(own.select("repo").distinct(), ["repo"], "left_anti")
    if both:
        old = theirs.select("repo", "path", F.col("issue_fingerprints").alias("old"))
        all_of = F.when(F.col("old").isNull(), F.col("issue_fingerprints")).otherwise(
            F.array_distinct(F.concat("old", F.coalesce("issue_fingerprints", F.expr("cast(array() as array<string>)")))))
        own = own.join(old, ["repo", "path"], "left").select("repo", "path", "content_hash", all_of.alias("issue_fingerprints"))
    return own.unionByName(others.select(*own.columns))


def write_history(history: DataFrame, base: str, based_on: int | None = None) -> int:
    """Commit the next version and return its number.

    `based_on` is the version the run read (default: the latest one now). The
    rows are written apart and published by a rename that fails if the number is
    taken. A writer that loses merges its rows, which are not computed again, with
    the version that won and tries the next number, so of writers at once all land.
    Rows of repositories that the run does not cover stay. The rename is atomic on
    HDFS and local file systems; object stores without one allow one writer at a time.
    """
    spark = history.sparkSession
    base = base.rstrip("/")
    seen = latest_history_version(spark, base) if based_on is None else based_on
    own, scratch = write_table(history.select("repo", "path", "content_hash", "issue_fingerprints"))
    try:
        while True:
            taken = _history_versions(spark, base)
            latest = max((v for v, complete in taken.items() if complete), default=None)
            rows = own if latest is None else merge_history(own, read_history(spark, base, latest), both=latest != seen)
            nxt = max(taken, default=0) + 1
            staged = f"{base}/_staging/{uuid.uuid4().hex}"
            rows.write.mode("errorifexists").parquet(staged)
            if _renamed_if_absent(spark, staged, f"{base}/version={nxt}"):
                return nxt
            delete_tables(spark, [staged])
    finally:
        delete_tables(spark, [scratch])


def _renamed_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE
    to = hadoop.Path(target)
    files = hadoop.FileContext.getFileContext(_fs(spark, target)[0].getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(hadoop.Path(source), to, options)
        return True
    except Py4JJavaError:
        if files.util().exists(to):
            return False
        raise


def expire_history(spark: SparkSession, base: str, keep: int = 10, stale_hours: float = 24) -> list[int]:
    """Delete all complete versions but the newest `keep`, and what writers left staged for `stale_hours`.

    Returns the versions deleted. `keep` must cover the versions that running readers use.
    """
    if keep < 1:
        raise ValueError("keep must be >= 1")
    base = base.rstrip("/")
    old = sorted(v for v, complete in _history_versions(spark, base).items() if complete)[:-keep]
    delete_tables(spark, [f"{base}/version={v}" for v in old])
    fs, staging = _fs(spark, f"{base}/_staging")
    if fs.exists(staging):
        before = (time.time() - stale_hours * 3600) * 1000
        delete_tables(spark, [st.getPath().toString() for st in fs.listStatus(staging) if st.getModificationTime() < before])
    return old


def read_history_json(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Import a JSON history document {"files": [...]}; a later duplicate path wins."""
    doc = spark.read.option("multiLine", "true").json(path)
    rows = doc.select(F.posexplode("files").alias("pos", "f")).select("pos", "f.*")
    last = rows.groupBy("path").agg(F.max_by(F.struct("content_hash", "issue_fingerprints"), "pos").alias("h"))
    return last.select(F.lit(repo).alias("repo"), "path", "h.content_hash", "h.issue_fingerprints")
