"""Sinks and feedback assembly."""

import json
import os
import tempfile

from corpuslint.operators import context as ctx
from corpuslint.operators import report as rep
from corpuslint.sinks import outputs
from corpuslint.sinks.outputs import (expire_history, json_reports, latest_history_version, markdown_documents, markdown_lines,
                                      read_history, read_history_json, write_history)
from corpuslint.session import cut_lineage
from tests.helpers import run


def reviewed(files, **options):
    """A run whose issues are written once, for the several documents read from them."""
    t = run(files, **options)
    t.extra["raw_issues", None] = cut_lineage(t.raw_issues())
    return t


TREE = {"main.py": "import os\npassword = 'x'\n\ndef BadName():\n    pass\n", "bad.py": "def broken(:\n"}


def test_json_report_and_trim(files_df):
    t = reviewed(files_df(TREE))
    doc = json.loads(json_reports(t, t.issues()).collect()[0].json)
    assert [p["path"] for p in doc["parsed_files"]] == ["main.py"]
    assert doc["failed_files"][0]["stage"] == "parse"
    assert {i["rule_id"] for i in doc["issues"]} >= {"security.hardcoded-secret", "style.function-name"}
    trimmed = json.loads(json_reports(t, t.issues(), rep.QueryOptions(include_parsed_files=False,
                                                                      include_project_graph=False)).collect()[0].json)
    assert "parsed_files" not in trimmed and "project_graph" not in trimmed


def test_markdown_sections(files_df):
    t = reviewed(files_df(TREE))
    md = markdown_documents(t, t.issues()).collect()[0].markdown
    assert md.startswith("# Code Review Report")
    assert md.index("## Issues") < md.index("## Failed Files")
    assert "- `bad.py` [parse]" in md


def test_documents_of_a_clean_repo(spark):
    from corpuslint.sinks.outputs import sarif_documents
    t = reviewed(spark.createDataFrame([("clean", "a.txt", "x", 1)], "repo string, path string, content string, size_bytes bigint"))
    none = t.issues().where("false")
    sarif = json.loads(sarif_documents(none, t.repos).collect()[0].sarif)
    assert sarif["runs"][0]["results"] == [] and sarif["runs"][0]["tool"]["driver"]["rules"] == []
    doc = json.loads(json_reports(t, none).collect()[0].json)
    assert doc["issues"] == [] and doc["parsed_files"] == [] and doc["project_graph"] == {"nodes": [], "edges": []}
    assert doc["metadata"]["executed_agents"] == ["structure", "performance", "security", "style", "test"]
    trimmed = json.loads(json_reports(t, none, rep.QueryOptions(include_review_context=False, include_feedback=False)).collect()[0].json)
    assert "review_context" not in trimmed and "feedback" not in trimmed and "review_context" in doc


def test_markdown_keeps_issue_order_and_sections(files_df):
    t = reviewed(files_df({"main.py": "import os\n" + "password = 'x'\n" * 12 + "def BadName():\n    pass\n"}))
    md = markdown_documents(t, t.issues()).collect()[0].markdown
    issues = [r for r in t.issues().orderBy("seq").collect()]
    listed = md.split("## Issues\n\n")[1].split("\n")
    assert listed == [f"- `{r.rule_id}` {r.severity} `{r.path}` {r.title}" for r in issues]
    assert md.index("## Parsed Files") < md.index("## Dependency Edges") < md.index("## Review Context") < md.index("## Feedback")
    assert "- `main.py` -> `os` confidence=0.3" in md and "- Total files: `1`" in md


def test_execution_section_and_its_switch(files_df, spark):
    t = reviewed(files_df(TREE))
    repo, none = t.repos.collect()[0].repo, t.issues().where("false")
    doc = json.loads(json_reports(t, none).collect()[0].json)
    families = ["structure", "performance", "security", "style", "test"]
    assert doc["execution"]["completed_order"] == families and doc["execution"]["failed_tasks"] == []
    assert doc["execution"]["progress"] == 1.0
    evidence = {r["task_id"]: r["evidence"] for r in doc["execution"]["task_results"]}
    assert evidence["test"] == ["has_test_file=False", "test_files=0"] and evidence["security"] == ["changed_files=1"]
    assert evidence["structure"][0].startswith("key_files=") and evidence["style"] == ["highlighted_paths=1"]
    off = rep.QueryOptions(include_execution=False)
    assert set(doc) - set(json.loads(json_reports(t, none, off).collect()[0].json)) == {"execution"}
    tasks = spark.createDataFrame(
        [(repo, "b", "style", 2, "failed", [], False), (repo, "c", "test", 1, "completed", [], False), (repo, "a", "x", 3, "completed", [], True),
         (repo, "d", "x", 4, "pending", [], False)],
        "repo string, task_id string, agent_name string, task_order int, status string, evidence array<string>, degraded boolean")
    got = rep.execution_record(t, tasks).collect()[0]
    assert (got.completed_order, got.failed_tasks, got.progress) == (["c", "a"], ["b"], 0.75)
    lines = [r.text for r in markdown_lines(t, none, task_results=tasks).orderBy("pos").collect()]
    at = lines.index("## Execution")
    assert lines[at + 2: at + 5] == ["- Progress: `0.75`", "- Completed tasks: `c, a`", "- Failed tasks: `b`"]
    assert lines.index("## Review Context") < at < lines.index("## Feedback")
    less = [r.text for r in markdown_lines(t, none, off).orderBy("pos").collect()]
    assert "## Execution" not in less and "## Feedback" in less
    fam = {r.agent: r for r in rep.family_reports(none, t.repos, ("test", "made_up"), rep.family_evidence(t)).collect()}
    assert fam["test"].evidence == ["has_test_file=False", "test_files=0"] and fam["made_up"].evidence == []


def test_file_contexts_carry_their_issues(files_df):
    t = reviewed(files_df({"main.py": "import os\npassword = 'x'\n", "clean.js": "x"}))
    by = {r.path: r for r in t.contexts_with_issues().collect()}
    assert {i.rule_id for i in by["main.py"].issues} >= {"security.hardcoded-secret", "structure.unused-import"}
    assert by["main.py"].suggestions == [i.title for i in by["main.py"].issues] and by["main.py"].dependencies
    bare = {r.path: r for r in ctx.with_issues(t.file_contexts, t.issues(), include_issue_lists=False).collect()}
    assert bare["main.py"].issues == [] and bare["main.py"].suggestions == by["main.py"].suggestions
    assert all(r.issues == r.suggestions == [] for r in ctx.with_issues(t.file_contexts, t.issues().where("false")).collect())


def test_feedback_reads_the_test_result(files_df, spark):
    t = reviewed(files_df(TREE))
    repo = t.repos.collect()[0].repo
    tasks = spark.createDataFrame([(repo, 4, "test", ["x", "test-result:failed:2 of 3"])],
                                  "repo string, task_order int, agent_name string, evidence array<string>")
    assert rep.feedback_record(t, tasks).collect()[0].test_summary == {"status": "failed", "detail": "2 of 3"}
    assert rep.feedback_record(t).collect()[0].test_summary == {"status": "not_run"}


def test_sort_without_a_page(files_df):
    t = reviewed(files_df(TREE))
    rows = rep.query_issues(t.issues(), rep.QueryOptions(sort_by="severity")).orderBy("page_pos").collect()
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    assert [rank[r.severity] for r in rows] == sorted(rank[r.severity] for r in rows) and len(rows) == t.issues().count()


def test_issue_lists_and_feedback(files_df):
    t = reviewed(files_df(TREE))
    per_file = {r.path: r for r in ctx.issues_per_file(t.issues()).collect()}
    assert "Hardcoded secret detected" in per_file["main.py"].suggestions
    fb = rep.feedback_record(t).collect()[0]
    assert fb.target_file_paths == ["main.py"]
    assert fb.verification_attempts[0].result == "failed"
    assert any("import" in f.lower() for f in fb.structure_findings)


def test_versioned_history_round_trip(files_df, spark):
    base = os.path.join(tempfile.mkdtemp(prefix="corpuslint-hist-"), "history")
    assert read_history(spark, base) is None
    t = reviewed(files_df(TREE))
    assert write_history(t.next_history(), base) == 1
    h = read_history(spark, base)
    assert {r.path for r in h.collect()} == {"main.py"}
    t2 = reviewed(files_df(TREE), history=h)
    assert t2.issues().count() == 0  # everything was reported last time
    assert write_history(t2.next_history(), base) == 2  # written beside the version it read


HISTORY = "repo string, path string, content_hash string, issue_fingerprints array<string>"


def rows_of(spark, base):
    return {(r.repo, r.path): (r.content_hash, r.issue_fingerprints) for r in read_history(spark, base).collect()}


def test_two_history_writers_at_once_both_land(spark):
    from concurrent.futures import ThreadPoolExecutor
    base = os.path.join(tempfile.mkdtemp(prefix="corpuslint-hist-"), "history")
    frames = [spark.createDataFrame([(f"r{i}", "a.py", str(i), [f"f{i}"]), ("shared", "b.py", "h", [f"f{i}"])], HISTORY) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda df: write_history(df, base, based_on=0), frames))
    assert sorted(versions) == [1, 2, 3, 4]
    rows = rows_of(spark, base)
    assert {k: rows[k] for k in rows if k[0] != "shared"} == {(f"r{i}", "a.py"): (str(i), [f"f{i}"]) for i in range(4)}
    assert sorted(rows["shared", "b.py"][1]) == ["f0", "f1", "f2", "f3"] and len(rows) == 5
    assert not os.listdir(os.path.join(base, "_staging"))


def test_a_lost_race_is_merged_with_its_winner(spark, monkeypatch):
    base = os.path.join(tempfile.mkdtemp(prefix="corpuslint-hist-"), "history")
    assert write_history(spark.createDataFrame([("a", "x.py", "1", ["p"]), ("a", "gone.py", "1", [])], HISTORY), base) == 1
    rename, other = outputs._renamed_if_absent, spark.createDataFrame([("a", "x.py", "2", ["q"]), ("b", "y.py", "1", None)], HISTORY)
    raced = []

    def late(session, source, target):
        if not raced:
            raced.append(target)
            assert write_history(other, base) == 2
        return rename(session, source, target)

    monkeypatch.setattr(outputs, "_renamed_if_absent", late)
    assert write_history(spark.createDataFrame([("a", "x.py", "3", ["p", "r"])], HISTORY), base) == 3
    assert rows_of(spark, base) == {("a", "x.py"): ("3", ["q", "p", "r"]), ("b", "y.py"): ("1", None)}


def test_an_incomplete_version_is_passed_over(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="corpuslint-hist-"), "history")
    os.makedirs(os.path.join(base, "version=1"))
    assert read_history(spark, base) is None
    assert write_history(spark.createDataFrame([], HISTORY), base) == 2 and read_history(spark, base).count() == 0


def test_history_expires(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="corpuslint-hist-"), "history")
    for i in range(4):
        write_history(spark.createDataFrame([("r", "a.py", str(i), [])], HISTORY), base)
    assert expire_history(spark, base, keep=2) == [1, 2] and expire_history(spark, base, keep=2) == []
    assert latest_history_version(spark, base) == 4 and read_history(spark, base, 3).first().content_hash == "2"


def test_history_json_import_last_duplicate_wins(spark):
    d = tempfile.mkdtemp(prefix="corpuslint-hjson-")
    path = os.path.join(d, "h.json")
    with open(path, "w") as fh:
        json.dump({"files": [{"path": "a.py", "content_hash": "1", "issue_fingerprints": []},
                             {"path": "a.py", "content_hash": "2", "issue_fingerprints": ["a.py:x"]}]}, fh, indent=2)
    rows = read_history_json(spark, path, "r").collect()
    assert [(r.path, r.content_hash, r.issue_fingerprints) for r in rows] == [("a.py", "2", ["a.py:x"])]
