"""Security rules (G1-G8), Python files only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.functions.columns import SECRET_REGEX, SPLITLINES_REGEX, py_strip
from corpuslint.operators.containment import points_inside
from corpuslint.operators.issues import catalogue_lookup, seq

# Detector order for one Call node (dispatch order of the AST rules).
CALL_DETECTORS = (
    "security.shell-true", "security.dynamic-execution", "security.insecure-deserialization",
    "security.unsafe-yaml-load", "security.tempfile-mktemp", "security.weak-random",
)


def call_rule(call_name, shell_true, loader_name):
    """G1-G6 as one CASE over a Call row (each call matches at most one detector)."""
    safe_loader = F.coalesce(loader_name.isin(*C.SAFE_YAML_LOADERS), F.lit(False))
    return (F.when((call_name == "os.system") | (call_name.isin("subprocess.run", "subprocess.Popen") & shell_true),
                   F.lit(CALL_DETECTORS[0]))
             .when(call_name.isin(*C.DYNAMIC_EXEC_CALLS), F.lit(CALL_DETECTORS[1]))
             .when(call_name.isin(*C.PICKLE_CALLS), F.lit(CALL_DETECTORS[2]))
             .when((call_name == C.YAML_LOAD_CALL) & ~safe_loader, F.lit(CALL_DETECTORS[3]))
             .when(call_name == C.MKTEMP_CALL, F.lit(CALL_DETECTORS[4]))
             .when(call_name.isin(*C.WEAK_RANDOM_CALLS), F.lit(CALL_DETECTORS[5])))


def _issue_cols(rule, path, line, evidence, order):
    return [
        F.col("repo"), F.lit("security").alias("agent"), rule.alias("rule_id"),
        catalogue_lookup(rule, 0).alias("title"), catalogue_lookup(rule, 1).alias("description"),
        catalogue_lookup(rule, 2).alias("severity"), path.alias("path"), line.cast("int").alias("line"),
        catalogue_lookup(rule, 3).cast("double").alias("confidence"), evidence.alias("evidence"), order.alias("seq"),
    ]


def call_issues(t, cfg) -> DataFrame:
    calls = t.facts.filter(F.col("node") == "Call").withColumn(
        "rule", call_rule(F.col("call_name"), F.col("shell_true"), F.col("loader_name")))
    hit = calls.filter(F.col("rule").isNotNull())
    det = F.array_position(F.array(*[F.lit(r) for r in CALL_DETECTORS]), F.col("rule"))
    return hit.select(*_issue_cols(F.col("rule"), F.col("path"), F.col("line"), F.array("call_name"),
                                   seq("security", 0, F.col("path"), 0, F.col("bfs") * 8 + det)))


def sql_concat(t, cfg) -> DataFrame:
    """An addition with an SQL literal somewhere below it; in `'SELECT ' + a + b` both additions."""
    adds = t.facts.filter(F.col("node") == "AddOp").select(
        "repo", "path", "pre", "last", F.col("bfs").alias("a_bfs"), F.col("line").alias("a_line"))
    literals = t.facts.filter(F.col("node") == "SqlStr").select("repo", "path", "pre")
    hit = points_inside(adds, literals, ["a_bfs", "a_line"])
    rule = F.lit("security.sql-string-concat")
    return hit.select(*_issue_cols(rule, F.col("path"), F.col("a_line"), F.array(F.lit("sql_concat")),
                                   seq("security", 0, F.col("path"), 0, F.col("a_bfs") * 8 + 7)))


def secret_lines(text_files: DataFrame) -> DataFrame:
    """G8 over texts of any table (repo, path, text), in the JVM: one row per matching line (line number, stripped line)."""
    lines = text_files.select("repo", "path", F.posexplode(F.split("text", SPLITLINES_REGEX)).alias("pos", "l"))
    hit = lines.filter(F.col("l").rlike(SECRET_REGEX))
    return hit.select("repo", "path", (F.col("pos") + 1).alias("line"), py_strip(F.col("l")).alias("evidence_line"))


def hardcoded_secret(t, cfg) -> DataFrame:
    """The parse stage has already found the lines."""
    hits = t.facts.filter(F.col("node") == "Secret")
    rule = F.lit("security.hardcoded-secret")
    return hits.select(*_issue_cols(rule, F.col("path"), F.col("line"), F.array("text"),
                                    seq("security", 0, F.col("path"), 1, F.col("line"))))


RULES = [
    (CALL_DETECTORS, call_issues),
    (("security.sql-string-concat",), sql_concat),
    (("security.hardcoded-secret",), hardcoded_secret),
]
