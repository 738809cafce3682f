"""Lane C queries: the whole parse-and-review pipeline over the corpus rendered from `part`.

Every rule runs on the real parse job; the oracle side derives the expected
issues from `part` by arithmetic (see ``corpuslint.sources.corpus`` for the
layout both sides follow).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.config import Settings
from corpuslint.functions.tables import register as register_table_functions
from corpuslint.operators import context as ctx
from corpuslint.operators import report as rep
from corpuslint.operators.issues import union_all
from corpuslint.operators.rules import performance, security, structure, style
from corpuslint.plans.analyze import analyze
from corpuslint.sources.corpus import corpus_files, corpus_oracle_cte
from corpuslint.sources.files import read_table

# Uncapped: every generated file is admitted, so results cover the whole table.
CORPUS_SETTINGS = Settings(max_files=None, max_total_bytes=None)


_SHARED: dict = {}     # one shared analysis: (session, sf_dir, settings) -> Tables
_TRANSIENT: list = []  # analyses built for a single query (the two-run queries)


def _drop_transient() -> None:
    while _TRANSIENT:
        _TRANSIENT.pop().release()


def corpus_tables(spark, sf, cfg: Settings = CORPUS_SETTINGS):
    """The corpus analysis shared by lane-C queries of one session: parse once, query many times.

    Only one analysis is held; asking for another scale or settings releases it.
    """
    _drop_transient()
    app = spark.sparkContext.applicationId
    key = (app, sf, repr(cfg))
    if key not in _SHARED:
        for (owner, *_), t in _SHARED.items():
            if owner == app:  # a stopped session's tables are gone with it
                t.release()
        _SHARED.clear()
        _SHARED[key] = analyze(corpus_files(read_table(spark, sf, "part")), None, cfg)
    return _SHARED[key]


def issue_view(df: DataFrame) -> DataFrame:
    return df.select("repo", "rule_id", "severity", "path", F.col("line").cast("bigint").alias("line"),
                     "confidence", F.array_join("evidence", "|").alias("evidence"))


def _rule_query(fn):
    def q(spark, sf):
        return issue_view(fn(corpus_tables(spark, sf), CORPUS_SETTINGS))
    q.__doc__ = fn.__doc__
    return q


def q_parse_failures(spark, sf):
    t = corpus_tables(spark, sf)
    return t.failed.select("repo", "path", "stage")


def q_parsed_files(spark, sf):
    t = corpus_tables(spark, sf)
    return t.parsed.select("repo", "path", "language", "parse_mode", F.array_join("imports", ",").alias("imports"))


def q_symbols(spark, sf):
    t = corpus_tables(spark, sf)
    out = []
    for kind in ("function", "class"):
        s = structure.explode_symbols(t.parsed, kind)
        out.append(s.select("repo", "path", "name", "kind", F.col("line_start").cast("bigint"),
                            F.col("line_end").cast("bigint"), F.col("parameter_count").cast("bigint")))
    return union_all(out)


def q_import_edges(spark, sf):
    t = corpus_tables(spark, sf)
    return t.edges.select("repo", "source", "target", "resolved", "resolution_confidence")


def q_key_files(spark, sf):
    t = corpus_tables(spark, sf)
    return t.key_files.select("repo", "path", F.col("score").cast("bigint").alias("score"), "reason",
                              F.col("rank").cast("bigint").alias("rank"))


def q_language_distribution(spark, sf):
    t = corpus_tables(spark, sf)
    return ctx.structure_summary(t.parsed).select("repo", "language", F.col("file_count").cast("bigint"),
                                                  F.col("total_files").cast("bigint"))


def q_focus_paths(spark, sf):
    t = corpus_tables(spark, sf)
    return t.focus.select("repo", "path", F.col("rank").cast("bigint").alias("rank"))


def q_highlighted(spark, sf):
    t = corpus_tables(spark, sf)
    return t.highlighted.select("repo", "path", F.col("rank").cast("bigint").alias("rank"))


def q_budget(spark, sf):
    t = corpus_tables(spark, sf)
    return t.budget.select("repo", "estimated_tokens", F.col("budget_limit").cast("bigint").alias("budget_limit"))


def q_run_metadata(spark, sf):
    return rep.run_metadata(corpus_tables(spark, sf))


def q_family_reports(spark, sf):
    t = corpus_tables(spark, sf)
    return rep.family_reports(t.raw_issues(), t.repos, C.FULL_FAMILIES)


def q_family_evidence(spark, sf):
    t = corpus_tables(spark, sf)
    return rep.family_evidence(t).select("repo", "agent", F.array_join("evidence", ";").alias("evidence"))


def q_file_suggestions(spark, sf):
    t = corpus_tables(spark, sf)
    t.write_issues()
    c = t.contexts_with_issues()
    return c.select("repo", "path", F.size("issues").cast("bigint").alias("issues"),
                    F.array_join(F.array_sort("suggestions"), ";").alias("suggestions"))


def _second_run(spark, sf):
    """Run 1 over the corpus, then run 2 over it with every `pkg0/` module edited (one call appended)."""
    from corpuslint.session import cut_lineage
    part = read_table(spark, sf, "part")
    files1 = corpus_files(part)
    _drop_transient()
    t1 = analyze(files1, None, CORPUS_SETTINGS)
    t1.write_issues()
    history = cut_lineage(t1.next_history())  # the stored state between runs
    t1.drop_written()
    t1.release()
    edited = F.when(F.col("path").startswith("pkg0/"), F.concat("content", F.lit("eval('2')\n"))).otherwise(F.col("content"))
    files2 = files1.withColumn("content", edited).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    t2 = analyze(files2, history, CORPUS_SETTINGS)
    _TRANSIENT.append(t2)
    return t2


def q_incremental_changes(spark, sf):
    return _second_run(spark, sf).changes.select("repo", "path", "status")


def q_incremental_new_issues(spark, sf):
    t = _second_run(spark, sf)
    t.write_issues()
    return issue_view(t.issues())


def q_all_issues(spark, sf):
    return issue_view(corpus_tables(spark, sf).raw_issues())


def q_issue_summary(spark, sf):
    return rep.summary_counts(corpus_tables(spark, sf).write_issues())


def q_security_calls(spark, sf):
    return issue_view(security.call_issues(corpus_tables(spark, sf), CORPUS_SETTINGS))


def q_sql_facts(spark, sf):
    """O3: functions and branches per module, by SQL over the table function `ast_facts`."""
    register_table_functions(spark)
    files = corpus_files(read_table(spark, sf, "part")).filter("path like 'pkg%'")
    return spark.sql("""
        SELECT f.repo, f.path, count_if(a.node = 'FunctionDef') AS functions, count_if(a.node IN ('If', 'For', 'While')) AS branches,
               count_if(a.node = '__error__') AS errors
        FROM {files} f, LATERAL ast_facts(f.content) a GROUP BY f.repo, f.path""", files=files)


def q_style(spark, sf):
    return issue_view(style.style_issues(corpus_tables(spark, sf), CORPUS_SETTINGS))


def q_tests(spark, sf):
    return issue_view(corpus_tables(spark, sf).raw_issues(FAMILY_RULES["test"]))


# ------------------------------------------------------------------ oracle SQL

def _rc(rule_id: str) -> str:
    title, _desc, sev, conf = C.RULES[rule_id]
    return f"'{rule_id}' AS rule_id, '{sev}' AS severity"


def _conf(rule_id: str) -> str:
    return f"CAST({C.RULES[rule_id][3]} AS DOUBLE) AS confidence"


_BASE = "WITH " + corpus_oracle_cte().strip() + """,
m AS (SELECT * FROM corpus WHERE ok),
parsed AS (
  SELECT repo, path, 'python' AS language FROM m
  UNION ALL SELECT repo, 'tests/test_m' || k || '.py', 'python' FROM corpus WHERE k % 3 = 0
  UNION ALL SELECT repo, 'web/app' || k || '.js', 'javascript' FROM corpus WHERE k % 10 = 1),
edges AS (
  SELECT repo, path AS source, 'os' AS target, FALSE AS resolved, CAST(0.3 AS DOUBLE) AS resolution_confidence,
         'os' AS module FROM m
  UNION ALL
  SELECT m.repo, m.path,
         CASE WHEN t.k IS NOT NULL THEN 'pkg' || (m.j % 4) || '/m' || m.j || '.py' ELSE 'pkg' || (m.j % 4) || '.m' || m.j END,
         t.k IS NOT NULL, CASE WHEN t.k IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END,
         'pkg' || (m.j % 4) || '.m' || m.j
  FROM m LEFT JOIN okset t ON t.k = m.j WHERE m.j IS NOT NULL)
"""

RULE_SQL = {
    "structure.circular-dependency": """
      SELECT repo, {rc}, p0 AS path, CAST(NULL AS BIGINT) AS line, {conf},
             p0 || ' -> ' || p1 || ' -> ' || p2 || ' -> ' || p3 || ' -> ' || p0 AS evidence
      FROM (
        SELECT c.repo,
               'pkg' || ((c.k + 25 * ((s + 0) % 4)) % 4) || '/m' || (c.k + 25 * ((s + 0) % 4)) || '.py' AS p0,
               'pkg' || ((c.k + 25 * ((s + 1) % 4)) % 4) || '/m' || (c.k + 25 * ((s + 1) % 4)) || '.py' AS p1,
               'pkg' || ((c.k + 25 * ((s + 2) % 4)) % 4) || '/m' || (c.k + 25 * ((s + 2) % 4)) || '.py' AS p2,
               'pkg' || ((c.k + 25 * ((s + 3) % 4)) % 4) || '/m' || (c.k + 25 * ((s + 3) % 4)) || '.py' AS p3
        FROM (SELECT repo, k, (4 - k % 4) % 4 AS s FROM m WHERE i % 4 = 0 AND (i // 4) % 3 = 0) c
        WHERE c.k + 25 IN (SELECT k FROM okset) AND c.k + 50 IN (SELECT k FROM okset) AND c.k + 75 IN (SELECT k FROM okset))""",
    "structure.large-function": "SELECT repo, {rc}, path, CAST(5 AS BIGINT) AS line, {conf}, "
                                "'function=f' || k || '|line_span=' || (1 + 2 * (z % 12) + z) AS evidence "
                                "FROM m WHERE 1 + 2 * (z % 12) + z > 40",
    "structure.complex-function": "SELECT repo, {rc}, path, CAST(5 AS BIGINT) AS line, {conf}, "
                                  "'function=f' || k || '|branch_nodes=' || (z % 12) AS evidence FROM m WHERE z % 12 > 8",
    "structure.unused-import": """
      SELECT repo, {rc}, path, CAST(1 AS BIGINT) AS line, {conf}, 'os' AS evidence FROM m WHERE z % 2 = 1
      UNION ALL
      SELECT repo, {rc}, path, CAST(2 AS BIGINT), {conf}, CASE WHEN i % 2 = 0 THEN 'f' ELSE 'm' END || j
      FROM m WHERE j IS NOT NULL""",
    "structure.unused-function": """
      SELECT repo, {rc}, path, CAST(5 AS BIGINT) AS line, {conf}, 'f' || k || '|heuristic=cross-file-name-reference' AS evidence
      FROM m WHERE NOT (i % 2 = 1 AND k - 25 IN (SELECT k FROM okset))
      UNION ALL
      SELECT repo, {rc}, path, CAST(l0 AS BIGINT), {conf}, 'Helper' || k || '|heuristic=cross-file-name-reference'
      FROM m WHERE k % 5 = 0""",
    "structure.unused-class": "SELECT repo, {rc}, path, CAST(l0 + 2 AS BIGINT) AS line, {conf}, "
                              "'item' || k || '|heuristic=cross-file-name-reference' AS evidence FROM m WHERE k % 8 = 0",
    "structure.large-review-scope": """
      SELECT repo, {rc}, arg_min(path, string_split(path, '/')) AS path, CAST(NULL AS BIGINT) AS line, {conf},
             'file_count=' || count(*) AS evidence
      FROM parsed GROUP BY repo HAVING count(*) > 20""",
    "security.shell-true": "SELECT repo, {rc}, path, CAST(l0 + 4 AS BIGINT) AS line, {conf}, 'subprocess.run' AS evidence FROM m WHERE k % 11 = 0",
    "security.dynamic-execution": "SELECT repo, {rc}, path, CAST(l0 + 4 AS BIGINT) AS line, {conf}, 'eval' AS evidence FROM m WHERE k % 11 IN (1, 7)",
    "security.insecure-deserialization": "SELECT repo, {rc}, path, CAST(l0 + 4 AS BIGINT) AS line, {conf}, 'pickle.loads' AS evidence FROM m WHERE k % 11 = 2",
    "security.unsafe-yaml-load": "SELECT repo, {rc}, path, CAST(l0 + 4 AS BIGINT) AS line, {conf}, 'yaml.load' AS evidence FROM m WHERE k % 11 = 3",
    "security.tempfile-mktemp": "SELECT repo, {rc}, path, CAST(l0 + 4 AS BIGINT) AS line, {conf}, 'tempfile.mktemp' AS evidence FROM m WHERE k % 11 = 4",
    "security.weak-random": "SELECT repo, {rc}, path, CAST(l0 + 4 AS BIGINT) AS line, {conf}, 'random.randint' AS evidence FROM m WHERE k % 11 = 5",
    "security.sql-string-concat": """
      SELECT repo, {rc}, path, CAST(l0 + 5 AS BIGINT) AS line, {conf}, 'sql_concat' AS evidence FROM m WHERE k % 13 IN (0, 1)
      UNION ALL
      SELECT repo, {rc}, path, CAST(l0 + 5 AS BIGINT), {conf}, 'sql_concat' FROM m WHERE k % 13 = 1""",
    "security.hardcoded-secret": "SELECT repo, {rc}, path, CAST(3 AS BIGINT) AS line, {conf}, "
                                 "'password = ''s' || k || '''' AS evidence FROM m WHERE k % 7 = 0",
    "style.function-name": "SELECT repo, {rc}, path, CAST(l0 AS BIGINT) AS line, {conf}, 'Helper' || k AS evidence FROM m WHERE k % 5 = 0",
    "style.function-length": "SELECT repo, {rc}, path, CAST(5 AS BIGINT) AS line, {conf}, "
                             "'function=f' || k || '|line_span=' || (1 + 2 * (z % 12) + z) AS evidence "
                             "FROM m WHERE 1 + 2 * (z % 12) + z > 30",
    "style.too-many-parameters": "SELECT repo, {rc}, path, CAST(5 AS BIGINT) AS line, {conf}, "
                                 "'function=f' || k || '|parameter_count=' || (z % 9) AS evidence FROM m WHERE z % 9 > 5",
    "style.class-name": "SELECT repo, {rc}, path, CAST(l0 + 2 AS BIGINT) AS line, {conf}, 'item' || k AS evidence FROM m WHERE k % 8 = 0",
    "performance.loop-io": """
      SELECT repo, {rc}, path, CAST(l0 + 8 AS BIGINT) AS line, {conf}, 'open' AS evidence FROM m WHERE k % 6 = 0
      UNION ALL
      SELECT repo, {rc}, path, CAST(l0 + 8 AS BIGINT), {conf}, 'open' FROM m WHERE k % 6 = 0
      UNION ALL
      SELECT repo, {rc}, path, CAST(l0 + 7 AS BIGINT), {conf}, 'open' FROM m WHERE k % 6 = 1""",
    "performance.repeated-len-call": """
      SELECT repo, {rc}, path, CAST(l0 + 9 AS BIGINT) AS line, {conf}, 'len_calls=2' AS evidence FROM m WHERE k % 6 = 0
      UNION ALL
      SELECT repo, {rc}, path, CAST(l0 + 9 AS BIGINT), {conf}, 'len_calls=2' FROM m WHERE k % 6 = 0
      UNION ALL
      SELECT repo, {rc}, path, CAST(l0 + 8 AS BIGINT), {conf}, 'len_calls=2' FROM m WHERE k % 6 = 1""",
    "test.no-tests-detected": """
      SELECT repo, {rc}, arg_min(path, string_split(path, '/')) AS path, CAST(NULL AS BIGINT) AS line, {conf},
             'heuristic=test-file-name-scan' AS evidence
      FROM parsed GROUP BY repo HAVING max(CASE WHEN path LIKE 'tests/%' THEN 1 ELSE 0 END) = 0""",
    "test.missing-targeted-test": """
      SELECT repo, {rc}, path, CAST(NULL AS BIGINT) AS line, {conf},
             'expected_tests=test_m' || k || '.py,m' || k || '_test.py,test_pkg' || (k % 4) || '_m' || k || '.py' AS evidence
      FROM m WHERE k % 3 <> 0
      UNION ALL
      SELECT repo, {rc}, 'web/app' || k || '.js', CAST(NULL AS BIGINT), {conf},
             'expected_tests=test_app' || k || '.py,app' || k || '_test.py,test_web_app' || k || '.py'
      FROM corpus WHERE k % 10 = 1""",
}


def rule_sql(rule_id: str) -> str:
    return RULE_SQL[rule_id].format(rc=_rc(rule_id), conf=_conf(rule_id))


def _union(rule_ids) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({rule_sql(r)})" for r in rule_ids)


def _single(rule_ids) -> str:
    return _BASE + _union(rule_ids)


FAMILY_RULES = {fam: [r for r in C.RULES if r.startswith(fam + ".") and r != "performance.context-budget"]
                for fam in C.FULL_FAMILIES}
ALL_RULES = [r for fam in C.FULL_FAMILIES for r in FAMILY_RULES[fam]]

_SYMBOLS_SQL = _BASE + """
SELECT repo, path, 'f' || k AS name, 'function' AS kind, CAST(5 AS BIGINT) AS line_start,
       CAST(5 + 2 * (z % 12) + z AS BIGINT) AS line_end, CAST(z % 9 AS BIGINT) AS parameter_count FROM m
UNION ALL SELECT repo, path, 'Helper' || k, 'function', CAST(l0 AS BIGINT), CAST(l0 + 1 AS BIGINT), CAST(0 AS BIGINT) FROM m WHERE k % 5 = 0
UNION ALL SELECT repo, path, 'item' || k, 'class', CAST(l0 + 2 AS BIGINT), CAST(l0 + 3 AS BIGINT), CAST(NULL AS BIGINT) FROM m WHERE k % 8 = 0
UNION ALL SELECT repo, 'tests/test_m' || k || '.py', 'test_m' || k, 'function', CAST(1 AS BIGINT), CAST(2 AS BIGINT), CAST(0 AS BIGINT)
FROM corpus WHERE k % 3 = 0"""

_PARSED_SQL = _BASE + """
SELECT p.repo, p.path, p.language, CASE WHEN p.language = 'python' THEN 'ast' ELSE 'text' END AS parse_mode,
       coalesce(i.imports, '') AS imports
FROM parsed p LEFT JOIN (
  SELECT repo, source AS path, string_agg(module, ',' ORDER BY module) AS imports FROM (
    SELECT repo, path AS source, 'os' AS module FROM m
    UNION ALL SELECT repo, path, 'pkg' || (j % 4) || '.m' || j FROM m WHERE j IS NOT NULL) GROUP BY 1, 2) i
  ON i.repo = p.repo AND i.path = p.path"""

_FAILURES_SQL = _BASE + "SELECT repo, path, 'parse' AS stage FROM corpus WHERE NOT ok"

_EDGES_SQL = _BASE + "SELECT repo, source, target, resolved, resolution_confidence FROM edges"

_KEYS_CTE = """,
ends AS (SELECT repo, source AS path FROM edges UNION ALL SELECT repo, target FROM edges WHERE resolved),
deg AS (SELECT repo, path, count(*) AS score FROM ends GROUP BY 1, 2),
keys AS (SELECT repo, path, score, 'high-degree' AS reason, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM deg) WHERE rank <= 10),
first_edges AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY string_split(source, '/'), module) AS edge_rank FROM edges)
  WHERE edge_rank <= 100),
touch AS (SELECT f.* FROM first_edges f WHERE EXISTS (
  SELECT 1 FROM keys k WHERE k.repo = f.repo AND (k.path = f.source OR k.path = f.target))),
ends2 AS (SELECT repo, source AS path, edge_rank, 0 AS e FROM touch UNION ALL SELECT repo, target, edge_rank, 1 FROM touch),
focus AS (SELECT repo, path, rank FROM (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY min(edge_rank * 2 + e)) AS rank
  FROM ends2 GROUP BY repo, path) WHERE rank <= 100),
hl AS (SELECT * FROM (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')) AS rank FROM parsed)
  WHERE rank <= 20),
nfiles AS (SELECT repo, count(*) AS n FROM parsed GROUP BY repo)
"""

_KEY_FILES_SQL = _BASE + _KEYS_CTE + """
SELECT repo, path, CAST(score AS BIGINT) AS score, reason, CAST(rank AS BIGINT) AS rank FROM keys"""

_FOCUS_SQL = _BASE + _KEYS_CTE + "SELECT repo, path, CAST(rank AS BIGINT) AS rank FROM focus"

_HIGHLIGHT_SQL = _BASE + _KEYS_CTE + "SELECT repo, path, CAST(rank AS BIGINT) AS rank FROM hl"

_BUDGET_ROWS = """
SELECT n.repo,
       CAST((SELECT sum(length(path)) FROM hl WHERE hl.repo = n.repo)
            + coalesce((SELECT sum(length(path) + length(reason)) FROM keys k WHERE k.repo = n.repo), 0)
            + coalesce((SELECT sum(length(path)) FROM focus f WHERE f.repo = n.repo), 0)
            + 40 * n.n AS BIGINT) AS estimated_tokens,
       CAST(12000 + 1000 * n.n AS BIGINT) AS budget_limit
FROM nfiles n"""

_BUDGET_SQL = _BASE + _KEYS_CTE + _BUDGET_ROWS

_RUN_META_SQL = _BASE + """
SELECT c.repo, CAST(count(*) + sum(CASE WHEN c.k % 3 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN c.k % 10 = 1 THEN 1 ELSE 0 END)
                    AS BIGINT) AS total_files_scanned,
       CAST(sum(CASE WHEN c.ok THEN 1 ELSE 0 END) + sum(CASE WHEN c.k % 3 = 0 THEN 1 ELSE 0 END)
            + sum(CASE WHEN c.k % 10 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_files_parsed,
       CAST(sum(CASE WHEN c.ok THEN 0 ELSE 1 END) AS BIGINT) AS total_failed_files,
       'structure,performance,security,style,test' AS executed_agents
FROM corpus c GROUP BY c.repo"""

_LANG_SQL = _BASE + """
SELECT repo, language, CAST(count(*) AS BIGINT) AS file_count,
       CAST(sum(count(*)) OVER (PARTITION BY repo) AS BIGINT) AS total_files
FROM parsed GROUP BY repo, language"""

_SUMMARY_SQL = _BASE + f""",
iss AS ({_union(ALL_RULES)})
SELECT repo,
       CASE WHEN GROUPING(severity) = 0 THEN 'severity' WHEN GROUPING(agent) = 0 THEN 'agent' ELSE 'total' END AS dimension,
       CASE WHEN GROUPING(severity) = 0 THEN severity WHEN GROUPING(agent) = 0 THEN agent ELSE '' END AS key,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT repo, severity, split_part(rule_id, '.', 1) AS agent FROM iss)
GROUP BY GROUPING SETS ((repo, severity), (repo, agent), (repo))"""

_FAMILY_SQL = _BASE + f""",
iss AS ({_union(ALL_RULES)}),
fams AS (SELECT unnest(['structure', 'security', 'style', 'performance', 'test']) AS agent),
grid AS (SELECT DISTINCT c.repo, f.agent FROM corpus c, fams f)
SELECT g.repo, g.agent, CAST(count(i.rule_id) AS BIGINT) AS issue_count,
       CASE WHEN count(i.rule_id) = 0 THEN 'info'
            ELSE CASE g.agent WHEN 'security' THEN 'high' WHEN 'performance' THEN 'medium' ELSE 'low' END END AS severity
FROM grid g LEFT JOIN iss i ON i.repo = g.repo AND split_part(i.rule_id, '.', 1) = g.agent
GROUP BY g.repo, g.agent"""

_SUGGESTIONS_SQL = _BASE + f""",
iss AS ({_union(ALL_RULES)}),
named AS (SELECT i.repo, i.path, t.title FROM iss i JOIN (VALUES {", ".join(f"('{r}', '{C.RULES[r][0]}')" for r in ALL_RULES)}) t(rule_id, title)
          ON t.rule_id = i.rule_id)
SELECT p.repo, p.path, CAST(count(n.title) AS BIGINT) AS issues, coalesce(string_agg(n.title, ';' ORDER BY n.title), '') AS suggestions
FROM parsed p LEFT JOIN named n ON n.repo = p.repo AND n.path = p.path GROUP BY p.repo, p.path"""

_EVIDENCE_SQL = _BASE + _KEYS_CTE + f""",
tokens AS ({_BUDGET_ROWS}),
per AS (
  SELECT n.repo, n.n AS files,
         (SELECT count(*) FROM keys k WHERE k.repo = n.repo) AS key_files,
         (SELECT count(*) FROM focus f WHERE f.repo = n.repo) AS focus_paths,
         (SELECT count(*) FROM hl WHERE hl.repo = n.repo) AS highlighted,
         (SELECT count(*) FROM parsed p WHERE p.repo = n.repo AND (starts_with(p.path, 'tests/') OR starts_with(p.path, 'test_') OR contains(p.path, '/test_'))) AS tests,
         (SELECT estimated_tokens FROM tokens b WHERE b.repo = n.repo) AS tokens
  FROM nfiles n)
SELECT repo, 'structure' AS agent, 'key_files=' || key_files || ';focus_paths=' || focus_paths AS evidence FROM per
UNION ALL SELECT repo, 'security', 'changed_files=' || files FROM per
UNION ALL SELECT repo, 'style', 'highlighted_paths=' || highlighted FROM per
UNION ALL SELECT repo, 'performance', 'estimated_tokens=' || tokens FROM per
UNION ALL SELECT repo, 'test', 'has_test_file=' || CASE WHEN tests > 0 THEN 'True' ELSE 'False' END || ';test_files=' || tests FROM per"""

_SQL_FACTS_SQL = _BASE + """
SELECT repo, path, CAST(CASE WHEN ok THEN 1 + (k % 5 = 0)::INT ELSE 0 END AS BIGINT) AS functions,
       CAST(CASE WHEN ok THEN z % 12 + CASE k % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS branches,
       CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS errors
FROM corpus"""

_INCR_CHANGES_SQL = _BASE + """
SELECT repo, path, CASE WHEN path LIKE 'pkg0/%' THEN 'changed' ELSE 'unchanged' END AS status FROM parsed"""

# Run 2 adds one dynamic-execution issue per edited module; everything else carries a title the
# file already had in run 1, so only edits in modules without an earlier eval are new.
_INCR_NEW_SQL = _BASE + f"""
SELECT repo, {_rc("security.dynamic-execution")}, path, CAST(l0 + 11 AS BIGINT) AS line,
       {_conf("security.dynamic-execution")}, 'eval' AS evidence
FROM m WHERE k % 4 = 0 AND k % 11 NOT IN (1, 7)"""

QUERIES = {
    "corpus_parse_failures": q_parse_failures,
    "corpus_parsed_files": q_parsed_files,
    "corpus_symbols": q_symbols,
    "corpus_import_edges": q_import_edges,
    "corpus_key_files": q_key_files,
    "corpus_language_distribution": q_language_distribution,
    "corpus_cycles": _rule_query(structure.circular_dependency),
    "corpus_large_function": _rule_query(structure.large_function),
    "corpus_complex_function": _rule_query(structure.complex_function),
    "corpus_unused_import": _rule_query(structure.unused_import),
    "corpus_unused_symbols": _rule_query(structure.unused_symbols),
    "corpus_large_scope": _rule_query(structure.large_review_scope),
    "corpus_security_calls": q_security_calls,
    "corpus_sql_concat": _rule_query(security.sql_concat),
    "corpus_secrets": _rule_query(security.hardcoded_secret),
    "corpus_sql_facts": q_sql_facts,
    "corpus_style": q_style,
    "corpus_loop_io": _rule_query(performance.loop_io),
    "corpus_repeated_len": _rule_query(performance.repeated_len),
    "corpus_tests": q_tests,
    "corpus_all_issues": q_all_issues,
    "corpus_issue_summary": q_issue_summary,
    "corpus_focus_paths": q_focus_paths,
    "corpus_highlighted": q_highlighted,
    "corpus_budget": q_budget,
    "corpus_run_metadata": q_run_metadata,
    "corpus_family_reports": q_family_reports,
    "corpus_family_evidence": q_family_evidence,
    "corpus_file_suggestions": q_file_suggestions,
    "corpus_incremental_changes": q_incremental_changes,
    "corpus_incremental_new_issues": q_incremental_new_issues,
}

ORACLES = {
    "corpus_parse_failures": _FAILURES_SQL,
    "corpus_parsed_files": _PARSED_SQL,
    "corpus_symbols": _SYMBOLS_SQL,
    "corpus_import_edges": _EDGES_SQL,
    "corpus_key_files": _KEY_FILES_SQL,
    "corpus_language_distribution": _LANG_SQL,
    "corpus_cycles": _single(["structure.circular-dependency"]),
    "corpus_large_function": _single(["structure.large-function"]),
    "corpus_complex_function": _single(["structure.complex-function"]),
    "corpus_unused_import": _single(["structure.unused-import"]),
    "corpus_unused_symbols": _single(["structure.unused-function", "structure.unused-class"]),
    "corpus_large_scope": _single(["structure.large-review-scope"]),
    "corpus_security_calls": _single([r for r in FAMILY_RULES["security"]
                                      if r not in ("security.sql-string-concat", "security.hardcoded-secret")]),
    "corpus_sql_concat": _single(["security.sql-string-concat"]),
    "corpus_secrets": _single(["security.hardcoded-secret"]),
    "corpus_sql_facts": _SQL_FACTS_SQL,
    "corpus_style": _single(FAMILY_RULES["style"]),
    "corpus_loop_io": _single(["performance.loop-io"]),
    "corpus_repeated_len": _single(["performance.repeated-len-call"]),
    "corpus_tests": _single(FAMILY_RULES["test"]),
    "corpus_all_issues": _single(ALL_RULES),
    "corpus_issue_summary": _SUMMARY_SQL,
    "corpus_focus_paths": _FOCUS_SQL,
    "corpus_highlighted": _HIGHLIGHT_SQL,
    "corpus_budget": _BUDGET_SQL,
    "corpus_run_metadata": _RUN_META_SQL,
    "corpus_family_reports": _FAMILY_SQL,
    "corpus_family_evidence": _EVIDENCE_SQL,
    "corpus_file_suggestions": _SUGGESTIONS_SQL,
    "corpus_incremental_changes": _INCR_CHANGES_SQL,
    "corpus_incremental_new_issues": _INCR_NEW_SQL,
}
