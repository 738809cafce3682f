"""Containment sweeps and the single content pass against plain nesting, and the shape of their plans."""

import random
import re

from corpuslint.operators.containment import enclosing, points_inside
from corpuslint.plans.analyze import analyze
from tests.helpers import UNCAPPED, issues_of, run


def _forest(rnd, size):
    """Nested-set numbers (pre, last) of a random tree."""
    out, counter = [], 0

    def grow(left):
        nonlocal counter
        pre, counter = counter, counter + 1
        left -= 1
        while left > 0:
            take = rnd.randint(1, left)
            grow(take)
            left -= take
        out.append((pre, counter - 1))

    grow(size)
    return sorted(out)


def test_sweeps_match_plain_nesting(spark):
    rnd = random.Random(4)
    inside, around, intervals, points = {}, set(), [], []
    for f in range(6):
        nodes = _forest(rnd, rnd.randint(1, 60))
        ivs = [n for n in nodes if rnd.random() < 0.4]
        pts = [n for n in nodes if rnd.random() < 0.5]
        intervals += [("r", f"p{f}", a, z, a * 10) for a, z in ivs]
        points += [("r", f"p{f}", a, a * 100) for a, _ in pts]
        for a, z in ivs:
            held = [p for p, _ in pts if a <= p <= z]
            if held:
                inside[f"p{f}", a * 10] = len(held)
            around |= {(f"p{f}", a * 10, p * 100) for p in held}
    iv = spark.createDataFrame(intervals, "repo string, path string, pre int, last int, iv int")
    pt = spark.createDataFrame(points, "repo string, path string, pre int, pt int")
    assert {(r.path, r.iv): r.n for r in points_inside(iv, pt, ["iv"]).collect()} == inside
    rows = [(r.path, r.iv, r.pt) for r in enclosing(pt, iv, "iv", ["pt"]).collect()]
    assert len(rows) == len(around) and set(rows) == around


def test_issue_plans_read_content_once_and_pair_nothing_by_range(spark, tmp_path):
    rows = [("r", "a.py", b"for i in x:\n    open(i)\n", 24), ("r", "b.js", b"1;\n", 3)]
    spark.createDataFrame(rows, "repo string, path string, content binary, size_bytes bigint").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    t = analyze(files, None, UNCAPPED.with_(families=("security", "style", "performance")), persist_facts=True)
    plan = t.raw_issues()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    joins = [line for line in plan.splitlines() if "Join" in line and ("last#" in line or "pre#" in line)]
    assert not joins  # no range residual
    scans = {cols for cols in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "content" in cols}
    assert len(scans) == 1  # printed wherever the persisted facts are read
    t.release()


def test_no_literal_text_leaves_the_parse_stage(files_df):
    t = run(files_df({"a.py": "x = 'some long literal'\nq = 'select ' + x\ntoken = 'abc'\n"}))
    rows = t.facts.collect()
    assert all("literal" not in (r.text or "") for r in rows)
    assert [r.line for r in rows if r.node == "SqlStr"] == [2]
    assert [(r.line, r.text) for r in rows if r.node == "Secret"] == [(3, "token = 'abc'")]
    assert len(issues_of(t, "security.sql-string-concat")) == 1


def test_secret_lines_follow_python_line_ends(files_df):
    t = run(files_df({"a.py": "x = 1\r\npassword = 'p'\x0c\r# é\x0btoken='t'\n"}))
    assert [(i["line"], i["evidence"]) for i in issues_of(t, "security.hardcoded-secret")] == [(2, ["password = 'p'"]), (5, ["token='t'"])]


def test_files_that_fail_each_give_one_row(files_df):
    t = run(files_df({"odd.py": "x = '\\ud800'\n", "bad.js": b"\xff\xfe", "ok.js": "1;\n", "syntax.py": "def (\n"}))
    assert sorted((r.path, r.stage) for r in t.failed.collect()) == [("bad.js", "parse"), ("odd.py", "parse"), ("syntax.py", "parse")]
    assert [r.path for r in t.parsed.collect()] == ["ok.js"]
