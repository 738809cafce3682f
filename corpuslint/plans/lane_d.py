"""Lane D queries: a driver table plays the role of an engine table by renaming.

Each function takes (spark, sf_dir) and returns a DataFrame; ``ORACLES`` holds
the same computation in DuckDB SQL over the raw driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.config import Settings
from corpuslint.functions.columns import (classify_error, content_hash, fingerprint, is_remote_ref,
                                          normalize_newlines, normalize_ref)
from corpuslint.operators import context as ctx
from corpuslint.operators import report as rep
from corpuslint.operators.issues import make_issues, seq
from corpuslint.operators.outcomes import breaker_states, events_as_outcomes, final_states, recovery_events
from corpuslint.operators.rules.security import secret_lines as _secret_lines
from corpuslint.operators.scan import admit
from corpuslint.sinks.outputs import sarif_results as _sarif_results, sarif_rules as _sarif_rules
from corpuslint.sources.files import read_table

# ------------------------------------------------------------------ helpers


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _doc_files(spark, sf) -> DataFrame:
    """documents as parsed files: repo=source, path=doc_id, newline-normalised text and its hash."""
    d = _docs(spark, sf)
    return d.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"),
                    normalize_newlines(F.col("text")).alias("text"), content_hash(F.col("text")).alias("content_hash"),
                    "doc_id", "lang", F.col("n_chars").alias("size_bytes"))


def _secret_issues(spark, sf) -> DataFrame:
    hits = _secret_lines(_doc_files(spark, sf).select("repo", "path", "text"))
    return make_issues(hits, "security.hardcoded-secret", path=F.col("path"), line=F.col("line"),
                       evidence=F.array("evidence_line"), order=seq("security", 0, F.col("path"), 1, F.col("line")))


def _previous_history(spark, sf) -> DataFrame:
    """A previous run's history: docs with doc_id % 3 <> 0 were seen; doc_id % 5 = 0 changed since."""
    d = _doc_files(spark, sf).filter(F.col("doc_id") % 3 != 0)
    h = F.when(F.col("doc_id") % 5 == 0, content_hash(F.concat("text", F.lit("x")))).otherwise(F.col("content_hash"))
    return d.select("repo", "path", h.alias("content_hash"), F.expr("cast(array() as array<string>)").alias("issue_fingerprints"))


# events as issues: one issue per event
SEVERITY_OF_EVENT = {"error": "high", "purchase": "medium", "view": "low", "click": "low", "signup": "critical"}
AGENT_OF_EVENT = {"error": "security", "purchase": "performance", "view": "structure", "click": "style", "signup": "test"}


def _event_issues(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "events")
    sev = F.create_map(*[x for k, v in SEVERITY_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    ag = F.create_map(*[x for k, v in AGENT_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("repo"),
        ag[F.col("event_type")].alias("agent"),
        F.concat(ag[F.col("event_type")], F.lit(".k"), k).alias("rule_id"),
        F.concat(F.lit("Event "), "event_type").alias("title"),
        F.concat(F.lit("Recorded "), "event_type", F.lit(" event")).alias("description"),
        sev[F.col("event_type")].alias("severity"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("event_id").cast("int").alias("line"),
        F.lit(0.5).alias("confidence"),
        F.array(F.col("event_type")).alias("evidence"),
        F.col("event_id").alias("seq"),
    )


def _issue_out(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    cols = [F.col("repo"), F.col("rule_id"), F.col("severity"), F.col("path"), F.col("line").cast("bigint").alias("line")]
    return df.select(*cols, *[F.col(c).cast("bigint").alias(c) for c in (extra or [])])


_EVENT_ISSUES_SQL = """
  SELECT 'r' || (user_id % 5) AS repo,
         CASE event_type WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'performance' WHEN 'view' THEN 'structure'
                         WHEN 'click' THEN 'style' WHEN 'signup' THEN 'test' END AS agent,
         CASE event_type WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'performance' WHEN 'view' THEN 'structure'
                         WHEN 'click' THEN 'style' WHEN 'signup' THEN 'test' END || '.k' || json_extract_string(props, '$.k') AS rule_id,
         'Event ' || event_type AS title,
         CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'view' THEN 'low'
                         WHEN 'click' THEN 'low' WHEN 'signup' THEN 'critical' END AS severity,
         'u' || user_id || '.py' AS path, event_id AS line, event_id AS seq
  FROM events"""

_SEV_RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END"

# --------------------------------------------------------------- G8 secrets

_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPLIT = r"[\n\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_SECRET_RE2 = "(?i)(password|secret|token|api_key)" + _WS + "*=" + _WS + "*['\"][^'\"]+['\"]"


def _sqlq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def q_secret_lines(spark: SparkSession, sf: str) -> DataFrame:
    hits = _secret_lines(_doc_files(spark, sf).select("repo", "path", "text"))
    return hits.select("repo", "path", F.col("line").cast("bigint").alias("line"), F.col("evidence_line").alias("evidence"))


_SECRET_SQL = f"""
WITH d AS (
  SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path,
         string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {_sqlq(_SPLIT)}) AS parts
  FROM documents),
l AS (SELECT repo, path, unnest(parts) AS l, unnest(generate_series(1, len(parts))) AS line FROM d)
SELECT repo, path, CAST(line AS BIGINT) AS line,
       regexp_replace(l, {_sqlq('^' + _WS + '+|' + _WS + '+$')}, '', 'g') AS evidence
FROM l WHERE regexp_matches(l, {_sqlq(_SECRET_RE2)})"""

# ----------------------------------------------------------- A3-A10 admission

_ADMIT_CFG = Settings(exclude_globs=("de/**", "**/src1/*"), max_file_bytes=15000, max_files=None, max_total_bytes=None)
_SUFFIX_SQL = "CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.java' WHEN 4 THEN '.md' ELSE '.py' END"


def _admission_files(spark, sf):
    d = _docs(spark, sf)
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".py", ".js", ".ts", ".java", ".md", ".py")]),
                          (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(F.col("source").alias("repo"),
                    F.concat("lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), suffix).alias("path"),
                    F.col("text").alias("content"), F.col("n_chars").alias("size_bytes"))


def q_scan_admission(spark, sf):
    return admit(_admission_files(spark, sf), _ADMIT_CFG).select("repo", "path", "size_bytes", "language", "skip_rule")


_ADMISSION_SQL = f"""
WITH f AS (SELECT source AS repo, lang || '/' || source || '/d' || doc_id || {_SUFFIX_SQL} AS path, n_chars AS size_bytes
           FROM documents)
SELECT repo, path, size_bytes,
       CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript'
            WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.java' THEN 'java' ELSE 'text' END AS language,
       CASE WHEN path LIKE 'de/%' OR path LIKE '%/src1/%' THEN 'exclude'
            WHEN NOT (path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.ts' OR path LIKE '%.java') THEN 'include'
            WHEN size_bytes > 15000 THEN 'max_file_bytes' END AS skip_rule
FROM f"""

# --------------------------------------------------------------- A7-A8 budget

_BUDGET_CFG = Settings(max_files=30, max_total_bytes=60000, max_file_bytes=None, exclude_globs=())


def _budget_files(spark, sf):
    d = _docs(spark, sf)
    return d.select(F.col("source").alias("repo"),
                    F.concat("lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
                    F.col("text").alias("content"), F.col("n_chars").alias("size_bytes"))


def q_scan_budget(spark, sf):
    return admit(_budget_files(spark, sf), _BUDGET_CFG).select("repo", "path", "size_bytes", "skip_rule")


_BUDGET_SQL = """
WITH RECURSIVE f AS (
  SELECT source AS repo, lang || '/d' || doc_id || '.py' AS path, n_chars AS size_bytes,
         row_number() OVER (PARTITION BY source ORDER BY string_split(lang || '/d' || doc_id || '.py', '/')) AS rn
  FROM documents),
r(repo, rn, path, size_bytes, skip_rule, cnt, tot) AS (
  SELECT repo, rn, path, size_bytes,
         CASE WHEN size_bytes > 60000 THEN 'max_total_bytes' END,
         CASE WHEN size_bytes <= 60000 THEN 1 ELSE 0 END,
         CASE WHEN size_bytes <= 60000 THEN size_bytes ELSE 0 END
  FROM f WHERE rn = 1
  UNION ALL
  SELECT f.repo, f.rn, f.path, f.size_bytes,
         CASE WHEN r.cnt >= 30 THEN 'max_files' WHEN r.tot + f.size_bytes > 60000 THEN 'max_total_bytes' END,
         r.cnt + CASE WHEN r.cnt < 30 AND r.tot + f.size_bytes <= 60000 THEN 1 ELSE 0 END,
         r.tot + CASE WHEN r.cnt < 30 AND r.tot + f.size_bytes <= 60000 THEN f.size_bytes ELSE 0 END
  FROM r JOIN f ON f.repo = r.repo AND f.rn = r.rn + 1)
SELECT repo, path, size_bytes, skip_rule FROM r"""

# ------------------------------------------------------------------ B2 hash


def q_content_hash(spark, sf):
    return _doc_files(spark, sf).select("repo", "path", "content_hash")


_HASH_SQL = """
SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, sha1(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS content_hash
FROM documents"""

# ----------------------------------------------------------------- D2, D3


def q_language_distribution(spark, sf):
    p = _docs(spark, sf).select(F.col("source").alias("repo"), F.col("lang").alias("language"))
    return ctx.structure_summary(p).select("repo", "language", F.col("file_count").cast("bigint"),
                                           F.col("total_files").cast("bigint"))


_LANG_SQL = """
SELECT repo, language, CAST(file_count AS BIGINT) AS file_count,
       CAST(sum(file_count) OVER (PARTITION BY repo) AS BIGINT) AS total_files
FROM (SELECT source AS repo, lang AS language, count(*) AS file_count FROM documents GROUP BY 1, 2)"""


def q_highlighted_paths(spark, sf):
    p = _budget_files(spark, sf).select("repo", "path")
    return ctx.first_paths(p, Settings().structure_summary_max_paths).select(
        "repo", "path", F.col("rank").cast("bigint").alias("rank"))


_HIGHLIGHT_SQL = """
SELECT repo, path, rank FROM (
  SELECT source AS repo, lang || '/d' || doc_id || '.py' AS path,
         row_number() OVER (PARTITION BY source ORDER BY string_split(lang || '/d' || doc_id || '.py', '/')) AS rank
  FROM documents) WHERE rank <= 20"""

# --------------------------------------------------------------- E2, E3, K1


def q_incremental_diff(spark, sf):
    return ctx.file_changes(_doc_files(spark, sf), _previous_history(spark, sf))


_HIST_CTE = """
cur AS (SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, doc_id,
               sha1(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS content_hash,
               regexp_replace(text, '\\r\\n?', chr(10), 'g') AS ntext FROM documents),
hist AS (SELECT repo, path, CASE WHEN doc_id % 5 = 0 THEN sha1(ntext || 'x') ELSE content_hash END AS content_hash
         FROM cur WHERE doc_id % 3 <> 0),
chg AS (SELECT c.repo, c.path,
               CASE WHEN h.content_hash IS NOT NULL AND h.content_hash = c.content_hash THEN 'unchanged' ELSE 'changed' END AS status
        FROM cur c LEFT JOIN hist h ON h.repo = c.repo AND h.path = c.path)"""

_DIFF_SQL = f"WITH {_HIST_CTE}\nSELECT repo, path, status FROM chg"


def q_target_files(spark, sf):
    return ctx.target_files(q_incremental_diff(spark, sf), Settings())


_TARGET_SQL = f"""WITH {_HIST_CTE}
SELECT repo, path FROM chg
WHERE status = 'changed' OR NOT EXISTS (SELECT 1 FROM chg c2 WHERE c2.repo = chg.repo AND c2.status = 'changed')"""


def q_new_issues(spark, sf):
    raw = _secret_issues(spark, sf)
    title = C.RULES["security.hardcoded-secret"][0]
    prev = _doc_files(spark, sf).filter(F.col("doc_id") % 2 == 0).select(
        "repo", "path", "content_hash", F.array(fingerprint(F.col("path"), F.lit(title))).alias("issue_fingerprints"))
    out = ctx.new_issues(raw, prev, Settings())
    return _issue_out(out)


_NEW_ISSUES_SQL = f"""
WITH s AS ({_SECRET_SQL})
SELECT repo, 'security.hardcoded-secret' AS rule_id, 'high' AS severity, path, line
FROM s WHERE NOT EXISTS (
  SELECT 1 FROM documents d WHERE d.doc_id % 2 = 0 AND d.source = s.repo AND CAST(d.doc_id AS VARCHAR) = s.path
    AND s.path || ':' || lower('{C.RULES["security.hardcoded-secret"][0]}') = CAST(d.doc_id AS VARCHAR) || ':hardcoded secret detected')"""

# ------------------------------------------------------------ L1-L8, L10-L11

_FILTER_OPTS = rep.QueryOptions(severity_filter=("high", "medium", "critical"), agent_filter=("security", "performance", "test"))
_PAGE_OPTS = rep.QueryOptions(sort_by="severity", offset=5, limit=20)
_BY_PATH_OPTS = rep.QueryOptions(agent_filter=("style", "structure"), sort_by="path", offset=3, limit=15)
_SUMMARY_PAGE_OPTS = rep.QueryOptions(severity_filter=("low",), sort_by="severity", offset=1, limit=2)


def q_issues_filtered(spark, sf):
    return _issue_out(rep.query_issues(_event_issues(spark, sf), _FILTER_OPTS))


_FILTERED_SQL = f"""
SELECT repo, rule_id, severity, path, CAST(line AS BIGINT) AS line FROM ({_EVENT_ISSUES_SQL})
WHERE severity IN ('high', 'medium', 'critical') AND split_part(rule_id, '.', 1) IN ('security', 'performance', 'test')"""


def q_issues_page(spark, sf):
    return _issue_out(rep.query_issues(_event_issues(spark, sf), _PAGE_OPTS), ["page_pos"])


_PAGE_SQL = f"""
SELECT repo, rule_id, severity, path, CAST(line AS BIGINT) AS line, page_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_SEV_RANK_SQL}, path, coalesce(line, 0), seq) AS page_pos
  FROM ({_EVENT_ISSUES_SQL})) WHERE page_pos > 5 AND page_pos <= 25"""


def q_issues_by_path(spark, sf):
    return _issue_out(rep.query_issues(_event_issues(spark, sf), _BY_PATH_OPTS), ["page_pos"])


_BY_PATH_SQL = f"""
SELECT repo, rule_id, severity, path, CAST(line AS BIGINT) AS line, page_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, coalesce(line, 0), rule_id, seq) AS page_pos
  FROM ({_EVENT_ISSUES_SQL}) WHERE split_part(rule_id, '.', 1) IN ('style', 'structure'))
WHERE page_pos > 3 AND page_pos <= 18"""


def q_issue_summary(spark, sf):
    return rep.summary_counts(_event_issues(spark, sf))


_SUMMARY_SQL = f"""
SELECT repo,
       CASE WHEN GROUPING(severity) = 0 THEN 'severity' WHEN GROUPING(agent) = 0 THEN 'agent' ELSE 'total' END AS dimension,
       CASE WHEN GROUPING(severity) = 0 THEN severity WHEN GROUPING(agent) = 0 THEN agent ELSE '' END AS key,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT repo, severity, split_part(rule_id, '.', 1) AS agent FROM ({_EVENT_ISSUES_SQL}))
GROUP BY GROUPING SETS ((repo, severity), (repo, agent), (repo))"""


def q_issue_summary_page(spark, sf):
    return rep.summary_counts(rep.query_issues(_event_issues(spark, sf), _SUMMARY_PAGE_OPTS))


_SUMMARY_PAGE_SQL = _SUMMARY_SQL.replace(f"FROM ({_EVENT_ISSUES_SQL}))", f"""FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_SEV_RANK_SQL}, path, coalesce(line, 0), seq) AS page_pos
                 FROM ({_EVENT_ISSUES_SQL}) WHERE severity IN ('low'))
  WHERE page_pos > 1 AND page_pos <= 3))""")

# ----------------------------------------------------------------- D4-D6

_EDGE_REPO = "concat('r', l_suppkey % 8)"


EDGES_PER_TASK = 500_000


def _lineitem_graph(spark, sf):
    """(nodes, edges, tasks). Key pairs compress so well that partitions sized by their bytes would hold tens
    of millions of them; so rows are dealt to a number of tasks that grows with the table."""
    li = read_table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    tasks = max(spark.sparkContext.defaultParallelism, li.count() // EDGES_PER_TASK)
    li = li.repartition(tasks, "l_suppkey", "l_partkey").distinct()
    edges = li.select(F.expr(_EDGE_REPO).alias("repo"),
                      F.concat(F.lit("supp/s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("source"),
                      F.concat(F.lit("part/p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("target"),
                      F.lit(True).alias("resolved"), F.col("l_partkey").cast("string").alias("module"))
    nodes = edges.select("repo", F.col("source").alias("path")).unionByName(
        edges.select("repo", F.col("target").alias("path"))).repartition(tasks, "repo", "path").distinct()
    return nodes, edges, tasks


def q_degree_topk(spark, sf):
    nodes, edges, tasks = _lineitem_graph(spark, sf)
    k = ctx.key_files(nodes, edges, Settings().key_files_cap, tasks)
    return k.select("repo", "path", F.col("score").cast("bigint").alias("score"), "reason",
                    F.col("rank").cast("bigint").alias("rank"))


_DEGREE_SQL = """
WITH e AS (SELECT DISTINCT 'r' || (l_suppkey % 8) AS repo, 'supp/s' || l_suppkey || '.py' AS source,
                           'part/p' || l_partkey || '.py' AS target FROM lineitem),
ends AS (SELECT repo, source AS path FROM e UNION ALL SELECT repo, target AS path FROM e),
deg AS (SELECT repo, path, count(*) AS score FROM ends GROUP BY 1, 2)
SELECT repo, path, CAST(score AS BIGINT) AS score, 'high-degree' AS reason, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM deg) WHERE rank <= 10"""

# -------------------------------------------------------------- A11-A13


def q_url_normalise(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", normalize_ref(F.col("url")).alias("normalized_ref"),
                    is_remote_ref(normalize_ref(F.col("url"))).alias("is_remote"))


_URL_SQL = """
SELECT page_id,
       CASE WHEN (starts_with(url, 'https://github.com/') OR starts_with(url, 'http://github.com/')) AND NOT ends_with(url, '.git')
            THEN url || '.git' ELSE url END AS normalized_ref,
       (starts_with(url, 'https://') OR starts_with(url, 'http://') OR starts_with(url, 'git@') OR starts_with(url, 'ssh://')
        OR starts_with(url, 'file://')) AS is_remote
FROM pages"""

ERROR_MESSAGES = (
    "ERROR: Repository not found.",
    "fatal: could not read Username: Permission denied",
    "fatal: unable to access: Could not resolve host: example.com",
    "warning: Remote branch feature not found in upstream origin",
    "fatal: reference is not a tree: abc123",
    "remote: Authentication failed for the url",
    "fatal: Failed to connect to host port 443",
    "error: something else happened",
    "fatal: couldn't find remote ref main",
)


def _error_log(spark, sf):
    e = read_table(spark, sf, "events")
    msgs = F.array(*[F.lit(m) for m in ERROR_MESSAGES])
    return e.select("event_id", F.element_at(msgs, (F.col("event_id") % 9 + 1).cast("int")).alias("message"))


def q_error_category(spark, sf):
    return _error_log(spark, sf).groupBy(classify_error(F.col("message")).alias("category")).agg(
        F.count("*").cast("bigint").alias("n"))


def _error_sql():
    msgs = " ".join(f"WHEN {i} THEN {_sqlq(m)}" for i, m in enumerate(ERROR_MESSAGES))
    conds = []
    for cat, needles in C.CLONE_ERROR_CATEGORIES:
        conds.append("WHEN " + " OR ".join(f"contains(lower(message), {_sqlq(n)})" for n in needles) + f" THEN '{cat}'")
    return f"""
SELECT CASE {' '.join(conds)} ELSE 'unknown' END AS category, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE event_id % 9 {msgs} END AS message FROM events) GROUP BY 1"""

# ----------------------------------------------------------------- M1-M6

BREAKER_THRESHOLD = 2
BREAKER_RESET_S = 6 * 3600


def _breaker(spark, sf):
    return breaker_states(events_as_outcomes(read_table(spark, sf, "events")), BREAKER_THRESHOLD, BREAKER_RESET_S)


def q_breaker_states(spark, sf):
    return _breaker(spark, sf).select("key", "event_id", "allowed", "status",
                                      F.col("consecutive_failures").cast("bigint").alias("consecutive_failures"),
                                      "opened_at_us", "degraded", "recovery_action")


_BREAKER_CTE = f"""
RECURSIVE o AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) AS ts_us, event_type = 'error' AS failed,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
s(key, rn, event_id, ts_us, failed, allowed, status, cnt, opened) AS (
  SELECT key, rn, event_id, ts_us, failed, TRUE,
         CASE WHEN failed AND 1 >= {BREAKER_THRESHOLD} THEN 'open' ELSE 'closed' END,
         CASE WHEN failed THEN 1 ELSE 0 END,
         CASE WHEN failed AND 1 >= {BREAKER_THRESHOLD} THEN ts_us END
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key, o.rn, o.event_id, o.ts_us, o.failed, NOT (s.status = 'open' AND s.opened IS NOT NULL AND o.ts_us - s.opened < {BREAKER_RESET_S * 1_000_000}),
         CASE WHEN (s.status = 'open' AND s.opened IS NOT NULL AND o.ts_us - s.opened < {BREAKER_RESET_S * 1_000_000}) THEN s.status
              WHEN NOT o.failed THEN 'closed'
              WHEN s.cnt + 1 >= {BREAKER_THRESHOLD} OR (s.status = 'open' AND s.opened IS NOT NULL AND o.ts_us - s.opened >= {BREAKER_RESET_S * 1_000_000}) THEN 'open' ELSE 'closed' END,
         CASE WHEN (s.status = 'open' AND s.opened IS NOT NULL AND o.ts_us - s.opened < {BREAKER_RESET_S * 1_000_000}) THEN s.cnt WHEN NOT o.failed THEN 0 ELSE s.cnt + 1 END,
         CASE WHEN (s.status = 'open' AND s.opened IS NOT NULL AND o.ts_us - s.opened < {BREAKER_RESET_S * 1_000_000}) THEN s.opened
              WHEN NOT o.failed THEN NULL
              WHEN s.cnt + 1 >= {BREAKER_THRESHOLD} OR (s.status = 'open' AND s.opened IS NOT NULL AND o.ts_us - s.opened >= {BREAKER_RESET_S * 1_000_000}) THEN o.ts_us ELSE s.opened END
  FROM s JOIN o ON o.key = s.key AND o.rn = s.rn + 1)"""

_BREAKER_SQL = f"""WITH {_BREAKER_CTE}
SELECT key, event_id, allowed, status, CAST(cnt AS BIGINT) AS consecutive_failures, opened AS opened_at_us,
       NOT allowed AS degraded,
       CASE WHEN NOT allowed THEN 'fallback_skip_with_degraded_mode' WHEN failed THEN 'record_failure' END AS recovery_action
FROM s"""


def q_breaker_final(spark, sf):
    return final_states(_breaker(spark, sf)).select(
        "key", "status", F.col("consecutive_failures").cast("bigint").alias("consecutive_failures"), "opened_at_us")


_BREAKER_FINAL_SQL = f"""WITH {_BREAKER_CTE}
SELECT key, status, CAST(cnt AS BIGINT) AS consecutive_failures, opened AS opened_at_us
FROM s QUALIFY rn = max(rn) OVER (PARTITION BY key)"""


def q_recovery_events(spark, sf):
    return recovery_events(_breaker(spark, sf)).select("key", "event_id", "scope", "target", "action", "reason")


_RECOVERY_SQL = f"""WITH {_BREAKER_CTE}
SELECT key, event_id, 'task' AS scope, key AS target,
       CASE WHEN NOT allowed THEN 'fallback_skip_with_degraded_mode' ELSE 'record_failure' END AS action,
       CASE WHEN NOT allowed THEN 'circuit_breaker_open' ELSE 'failed' END AS reason
FROM s WHERE NOT allowed OR failed"""


def q_execution_rollup(spark, sf):
    st = _breaker(spark, sf)
    tasks = st.select(F.col("key").alias("repo"),
                      F.when(F.col("allowed") & F.col("failed"), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
                      F.col("degraded"))
    return rep.execution_rollup(tasks)


_ROLLUP_SQL = f"""WITH {_BREAKER_CTE}
SELECT key AS repo, CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CASE WHEN NOT (allowed AND failed) THEN 1 ELSE 0 END) AS BIGINT) AS completed,
       CAST(sum(CASE WHEN allowed AND failed THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       CAST(count(*) AS BIGINT) AS done,
       CAST(sum(CASE WHEN NOT allowed THEN 1 ELSE 0 END) AS BIGINT) AS degraded,
       CAST(1.0 AS DOUBLE) AS progress
FROM s GROUP BY key"""

# ------------------------------------------------------------- K3, K4, K6


def q_feedback_by_file(spark, sf):
    return rep.issue_counts_by_file(_event_issues(spark, sf))


_FB_FILE_SQL = f"SELECT repo, path, CAST(count(*) AS BIGINT) AS n FROM ({_EVENT_ISSUES_SQL}) GROUP BY 1, 2"


def q_feedback_by_agent(spark, sf):
    return rep.issue_counts_by_agent(_event_issues(spark, sf))


_FB_AGENT_SQL = f"SELECT repo, agent, CAST(count(*) AS BIGINT) AS n FROM ({_EVENT_ISSUES_SQL}) GROUP BY 1, 2"


def q_feedback_verification(spark, sf):
    iss = _event_issues(spark, sf).filter(F.col("severity").isin("critical", "high"))
    counts = iss.groupBy("repo").agg(F.count("*").alias("n_issues"))
    repos = _event_issues(spark, sf).select("repo").distinct()
    v = rep.verification(repos.join(counts, ["repo"], "left"), True)
    return v.select("repo", F.col("attempt").cast("bigint").alias("attempt"), "action", "result", "detail")


_FB_VERIFY_SQL = f"""
SELECT repo, CAST(1 AS BIGINT) AS attempt, 'review_output_validation' AS action,
       CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS result,
       CASE WHEN n > 0 THEN 'issues_detected=' || n ELSE 'no_issues_detected' END AS detail
FROM (SELECT repo, sum(CASE WHEN severity IN ('critical', 'high') THEN 1 ELSE 0 END) AS n FROM ({_EVENT_ISSUES_SQL}) GROUP BY repo)"""

# ---------------------------------------------------------------- N2, N3


def q_sarif_results(spark, sf):
    iss = rep.query_issues(_event_issues(spark, sf), _FILTER_OPTS).withColumn("confidence", F.lit(0.5))
    r = _sarif_results(iss)
    return r.select("repo", F.col("result.ruleId").alias("rule_id"), F.col("result.level").alias("level"),
                    F.col("result.message.text").alias("message"),
                    F.col("result.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
                    F.col("result.locations")[0]["physicalLocation"]["region"]["startLine"].cast("bigint").alias("start_line"),
                    F.col("result.properties.severity").alias("severity"))


_SARIF_RESULTS_SQL = f"""
SELECT repo, rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning'
                                    ELSE 'note' END AS level,
       title AS message, path AS uri, CAST(line AS BIGINT) AS start_line, severity
FROM ({_EVENT_ISSUES_SQL})
WHERE severity IN ('high', 'medium', 'critical') AND split_part(rule_id, '.', 1) IN ('security', 'performance', 'test')"""


def q_sarif_rules(spark, sf):
    iss = rep.query_issues(_event_issues(spark, sf), _FILTER_OPTS)
    r = _sarif_rules(iss)
    return r.select("repo", F.col("rule.id").alias("rule_id"), F.col("rule.name").alias("name"),
                    F.col("rule.helpUri").alias("help_uri"), F.col("rule.properties.severity").alias("severity"))


_SARIF_RULES_SQL = f"""
SELECT repo, rule_id, arg_min(title, seq) AS name, '{C.SARIF_HELP_URI_PREFIX}' || rule_id AS help_uri,
       arg_min(severity, seq) AS severity
FROM ({_EVENT_ISSUES_SQL})
WHERE severity IN ('high', 'medium', 'critical') AND split_part(rule_id, '.', 1) IN ('security', 'performance', 'test')
GROUP BY repo, rule_id"""

QUERIES = {
    "secret_lines": q_secret_lines,
    "scan_admission": q_scan_admission,
    "scan_budget": q_scan_budget,
    "content_hash": q_content_hash,
    "language_distribution": q_language_distribution,
    "highlighted_paths": q_highlighted_paths,
    "incremental_diff": q_incremental_diff,
    "target_files": q_target_files,
    "new_issues": q_new_issues,
    "issues_filtered": q_issues_filtered,
    "issues_page": q_issues_page,
    "issues_by_path": q_issues_by_path,
    "issue_summary": q_issue_summary,
    "issue_summary_page": q_issue_summary_page,
    "degree_topk": q_degree_topk,
    "url_normalise": q_url_normalise,
    "error_category": q_error_category,
    "breaker_states": q_breaker_states,
    "breaker_final": q_breaker_final,
    "recovery_events": q_recovery_events,
    "execution_rollup": q_execution_rollup,
    "feedback_by_file": q_feedback_by_file,
    "feedback_by_agent": q_feedback_by_agent,
    "feedback_verification": q_feedback_verification,
    "sarif_results": q_sarif_results,
    "sarif_rules": q_sarif_rules,
}

ORACLES = {
    "secret_lines": _SECRET_SQL,
    "scan_admission": _ADMISSION_SQL,
    "scan_budget": _BUDGET_SQL,
    "content_hash": _HASH_SQL,
    "language_distribution": _LANG_SQL,
    "highlighted_paths": _HIGHLIGHT_SQL,
    "incremental_diff": _DIFF_SQL,
    "target_files": _TARGET_SQL,
    "new_issues": _NEW_ISSUES_SQL,
    "issues_filtered": _FILTERED_SQL,
    "issues_page": _PAGE_SQL,
    "issues_by_path": _BY_PATH_SQL,
    "issue_summary": _SUMMARY_SQL,
    "issue_summary_page": _SUMMARY_PAGE_SQL,
    "degree_topk": _DEGREE_SQL,
    "url_normalise": _URL_SQL,
    "error_category": _error_sql(),
    "breaker_states": _BREAKER_SQL,
    "breaker_final": _BREAKER_FINAL_SQL,
    "recovery_events": _RECOVERY_SQL,
    "execution_rollup": _ROLLUP_SQL,
    "feedback_by_file": _FB_FILE_SQL,
    "feedback_by_agent": _FB_AGENT_SQL,
    "feedback_verification": _FB_VERIFY_SQL,
    "sarif_results": _SARIF_RESULTS_SQL,
    "sarif_rules": _SARIF_RULES_SQL,
}
