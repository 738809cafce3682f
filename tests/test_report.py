"""Report queries (L), feedback (K) and sinks (N)."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslint.operators import report as rep
from corpuslint.sinks.outputs import sarif_documents
from tests.helpers import run


def _issues(spark):
    rows = [("r", "security", "security.a", "A", "d", "high", "x.py", 5, 0.9, ["e"], 1),
            ("r", "style", "style.b", "B", "d", "low", "a.py", 3, 0.9, ["e"], 2),
            ("r", "style", "style.c", "C", "d", "low", "a.py", None, 0.9, ["e"], 3),
            ("r", "test", "test.d", "D", "d", "low", "b.py", 1, 0.9, ["e"], 4),
            ("r", "structure", "structure.e", "E", "d", "medium", "c.py", 2, 0.9, ["e"], 5)]
    return spark.createDataFrame(rows, "repo string, agent string, rule_id string, title string, description string, "
                                       "severity string, path string, line int, confidence double, "
                                       "evidence array<string>, seq long")


def test_filters_sort_and_page(spark):
    df = _issues(spark)
    out = rep.query_issues(df, rep.QueryOptions(sort_by="path", offset=1, limit=2)).orderBy("page_pos").collect()
    assert [(r.path, r.line) for r in out] == [("a.py", 3), ("b.py", 1)]
    low = rep.query_issues(df, rep.QueryOptions(severity_filter=("low",), agent_filter=("style",))).collect()
    assert {r.rule_id for r in low} == {"style.b", "style.c"}
    by_path = rep.query_issues(df, rep.QueryOptions(path_filter=("x.py",))).collect()
    assert [r.rule_id for r in by_path] == ["security.a"]
    sev = rep.query_issues(df, rep.QueryOptions(sort_by="severity", limit=2)).orderBy("page_pos").collect()
    assert [r.rule_id for r in sev] == ["security.a", "structure.e"]


def test_positions_over_ranges(spark):
    from corpuslint.operators.positions import numbered
    rows = [("big", (i * 37) % 500, i) for i in range(2000)] + [(None, 1, 5), (None, 0, 6), ("small", 3, 7)]
    df = spark.createDataFrame(rows, "repo string, k int, seq long")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = numbered(df, "repo", [F.col("k"), F.col("seq")], "pos")
        got = {(r.repo, r.seq): r.pos for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = {}
    for repo in ("big", "small", None):
        for pos, (_, _, seq) in enumerate(sorted((r for r in rows if r[0] == repo), key=lambda r: r[1:]), 1):
            want[repo, seq] = pos
    assert got == want and out.columns == ["repo", "k", "seq", "pos"]
    assert numbered(df.where("false"), "repo", [F.col("seq")], "pos").count() == 0


def test_offset_without_limit(spark):
    out = rep.query_issues(_issues(spark), rep.QueryOptions(sort_by="path", offset=3)).orderBy("page_pos").collect()
    assert [(r.path, r.page_pos) for r in out] == [("c.py", 4), ("x.py", 5)]


def test_page_limited_summary(spark):
    page = rep.query_issues(_issues(spark), rep.QueryOptions(severity_filter=("low",), offset=1, limit=2))
    s = {(r.dimension, r.key): r.n for r in rep.summary_counts(page).collect()}
    assert s[("total", "")] == 2 and s[("severity", "low")] == 2


@pytest.mark.parametrize("kw", [dict(sort_by="created_at"), dict(offset=-1), dict(limit=0)])
def test_bad_options_rejected(kw):
    with pytest.raises(ValueError):
        rep.QueryOptions(**kw)


def test_summary_record_maps_sorted(spark):
    df = _issues(spark)
    parsed = spark.createDataFrame([("r", "a.py")], "repo string, path string")
    out = rep.summary_record(df, parsed, parsed, parsed.select("repo"))
    rec = out.select("total_issues", "total_files_parsed", F.to_json("severity_counts").alias("sev")).collect()[0]
    assert list(json.loads(rec.sev)) == ["high", "low", "medium"]  # key-sorted in the sink text
    assert rec.total_issues == 5 and rec.total_files_parsed == 1


def test_sarif_document(files_df):
    t = run(files_df({"s.py": "password = 'x'\n"}))
    doc = json.loads(sarif_documents(t.raw_issues().filter(F.col("agent") == "security")).collect()[0].sarif)
    assert doc["version"] == "2.1.0" and len(doc["runs"]) == 1
    rules = doc["runs"][0]["tool"]["driver"]["rules"]
    assert rules[0]["id"] == "security.hardcoded-secret" and rules[0]["helpUri"].endswith(rules[0]["id"])
    res = doc["runs"][0]["results"][0]
    assert res["level"] == "error" and res["locations"][0]["physicalLocation"]["region"] == {"startLine": 1}


def test_region_empty_without_line(spark):
    from corpuslint.sinks.outputs import sarif_results
    df = _issues(spark).filter("line is null")
    out = sarif_results(df).select(F.to_json("result").alias("j")).collect()[0].j
    assert '"region":{}' in out


def test_verification_and_family_reports(spark):
    counts = spark.createDataFrame([("r", 3), ("q", None)], "repo string, n_issues long")
    v = {r.repo: (r.result, r.detail) for r in rep.verification(counts, True).collect()}
    assert v == {"r": ("failed", "issues_detected=3"), "q": ("passed", "no_issues_detected")}
    fam = rep.family_reports(_issues(spark), spark.createDataFrame([("r",)], "repo string"), ("structure", "performance"))
    got = {r.agent: (r.issue_count, r.severity) for r in fam.collect()}
    assert got == {"structure": (1, "low"), "performance": (0, "info")}


def test_test_summary_tag(spark):
    tr = spark.createDataFrame([("r", 0, "test", ["has_test_file=True", "test-result:skipped:execution_disabled"]),
                                ("q", 0, "style", ["x"])],
                               "repo string, task_order int, agent_name string, evidence array<string>")
    got = {r.repo: (r.status, r.detail) for r in rep.test_summary(tr).collect()}
    assert got == {"r": ("skipped", "execution_disabled"), "q": ("not_run", None)}
    bare = spark.createDataFrame([("r", 0, "test", ["test-result:passed"])], tr.schema)
    assert [(r.status, r.detail) for r in rep.test_summary(bare).collect()] == [("passed", "")]
