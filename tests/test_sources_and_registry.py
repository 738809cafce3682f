"""Bad files each fail alone, the data source prunes by size and path, the table function, and added rule families."""

import os

import pytest
from pyspark.sql import functions as F

from corpuslint.functions import tables
from corpuslint.operators import report as rep
from corpuslint.operators.issues import make_issues, seq
from corpuslint.operators.rules import registry
from corpuslint.plans.analyze import analyze
from corpuslint.sources import repo_files
from corpuslint.sources.files import _read_files, read_directory
from tests.helpers import UNCAPPED, run


@pytest.fixture
def tree(tmp_path):
    for name, text in [("r1/main.py", "x = 1\n"), ("r1/pkg/_a.py", "y = 22\n"), ("r2/b.js", "z;\n"), ("r2/big.py", "#" * 500), ("top.py", "t = 1\n")]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    with open(os.path.join(os.fsencode(tmp_path), b"r1", b"odd\xff.py"), "wb") as f:
        f.write(b"odd = 1\n")
    os.symlink(tmp_path / "gone.py", tmp_path / "r2" / "dangling.py")
    return str(tmp_path)


def test_bad_names_and_vanished_files_are_one_failed_row(spark, tree):
    repo_files.register(spark)
    for files in (read_directory(spark, tree), spark.read.format("repo_files").option("partitions", 3).load(tree)):
        rows = {(r.repo, r.path): r for r in files.collect()}
        assert set(rows) == {("r1", "main.py"), ("r1", "pkg/_a.py"), ("r1", "odd\\xff.py"), ("r2", "b.js"), ("r2", "big.py"), (".", "top.py")}
        assert rows["r1", "odd\\xff.py"].read_error and rows["r1", "odd\\xff.py"].content is None
        assert bytes(rows["r1", "pkg/_a.py"].content) == b"y = 22\n" and rows["r1", "pkg/_a.py"].size_bytes == 7
    t = analyze(read_directory(spark, tree), None, UNCAPPED.with_(families=("style",)))
    assert [(r.path, r.reason, r.stage) for r in t.failed.collect()] == [("odd\\xff.py", "its name is not UTF-8", "parse")]
    t.release()


def test_a_file_that_goes_between_listing_and_reading(tree):
    import pyarrow as pa
    listed = pa.RecordBatch.from_pylist([{"repo": "r", "path": p, "rel": p, "size_bytes": 5, "read_error": None} for p in ("top.py", "left.py")])
    rows = [b.to_pylist()[0] for b in _read_files(tree, None, [listed])]
    assert [(r["path"], r["content"] is None, r["read_error"] is None) for r in rows] == [("top.py", False, True), ("left.py", True, False)]


def test_size_and_path_filters_reach_the_source(spark, tree):
    repo_files.register(spark)
    files = spark.read.format("repo_files").load(tree)
    small = files.filter("size_bytes <= 7 and repo = 'r1' and path like 'pkg/%'")
    assert [r.path for r in small.collect()] == ["pkg/_a.py"]
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(small._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "LessThanOrEqual(size_bytes,7)" in pushed and "EqualTo(repo,r1)" in pushed and "StringStartsWith(path,pkg/)" in pushed
    reader = repo_files.RepoFilesReader({"path": tree})
    pushed = [repo_files.LessThan(("size_bytes",), 100), repo_files.StringStartsWith(("path",), "b"), repo_files.EqualTo(("content",), b"")]
    assert list(reader.pushFilters(pushed)) == pushed[2:]
    read = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["path"] for r in read] == ["b.js"]


def test_table_function(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "def f(a):\n    if a:\n        pass\n"), (2, "def ("), (3, None)], "k int, src string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT k, a.node, a.name, a.n_params FROM sources, LATERAL ast_facts(src) a").collect()
    assert {(r.k, r.node) for r in rows} >= {(1, "FunctionDef"), (1, "If"), (2, "__error__"), (3, "__undecodable__")}
    assert [(r.name, r.n_params) for r in rows if r.node == "FunctionDef"] == [("f", 1)]


def test_only_the_rules_asked_for_are_planned(files_df, monkeypatch):
    from corpuslint.operators.rules import structure
    searched = []
    search = structure.cycle_rows
    monkeypatch.setattr(structure, "cycle_rows", lambda *a: searched.append(1) or search(*a))
    t = run(files_df({"a.py": "import b\neval('1')\npickle.loads(x)\n", "b.py": "import a\n"}))
    high = t.query(rep.QueryOptions(severity_filter=("high",)))
    assert not searched
    assert [r.rule_id for r in high.collect()] == ["security.insecure-deserialization"]
    assert {r.rule_id for r in t.raw_issues(["style.class-name", "security.dynamic-execution"]).collect()} == {"security.dynamic-execution"}
    assert not searched
    medium = t.query(rep.QueryOptions(severity_filter=("medium",), agent_filter=("structure",)))
    assert searched and [r.rule_id for r in medium.collect()] == ["structure.circular-dependency"]


def test_an_added_family_stands_with_the_others(files_df):
    def long_name(t, cfg):
        hit = t.parsed.filter(F.length("path") > 10)
        return make_issues(hit, "naming.long-path", path=F.col("path"), line=None, evidence=F.array(F.lit("long")), order=seq("naming", 0, F.col("path")))

    rule = {"naming.long-path": ("Path is long", "A path has many characters.", "low", 0.5)}
    with pytest.raises(ValueError):
        registry.add_family("naming", rule, [(("other.rule",), long_name)])
    registry.add_family("naming", rule, [(("naming.long-path",), long_name)])
    try:
        t = run(files_df({"a.py": "x = 1\n", "a_rather_long_name.py": "y = 1\n"}))
        issues = t.raw_issues().collect()
        assert [i.path for i in issues if i.agent == "naming"] == ["a_rather_long_name.py"]
        assert any(i.agent == "test" for i in issues)
    finally:
        registry.remove_family("naming")
    assert "naming" not in registry.FAMILIES
