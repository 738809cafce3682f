"""What keeps tasks and the driver the same size when tables grow."""

import ast
import random
import re
from collections import Counter
from types import SimpleNamespace

from corpuslint.config import RULES
from corpuslint.operators import extract, graph
from corpuslint.operators.issues import union_all
from corpuslint.operators.rules import coverage, registry, structure
from corpuslint.plans import analyze as analyze_module
from corpuslint.plans import lane_c, lane_d
from corpuslint.plans.analyze import analyze
from corpuslint.session import delete_tables
from corpuslint.sources import corpus
from tests.helpers import UNCAPPED, run


def _partitions(df):
    return df.rdd.getNumPartitions()



def test_corpus_spreads_over_more_tasks_as_part_grows(spark, monkeypatch):
    part = spark.range(0, 200, 1, 2).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size")
    monkeypatch.setattr(corpus, "SEEDS_PER_TASK", 10, raising=False)
    assert _partitions(corpus.corpus_files(part)) == 20
    files = {(r.repo, r.path) for r in corpus.corpus_files(part).collect()}
    assert len(files) == 200 + len(range(0, 200, 3)) + len(range(1, 200, 10))


def test_numbers_are_those_of_two_walks():
    rnd = random.Random(3)
    source = "\n".join(rnd.choice(["def f(a, b=1):\n    return [x for x in a if x]", "class C(B):\n    y: int = 'SELECT ' + z",
                                   "for i in j:\n    while k:\n        open(i)", "with a as b, c:\n    x = {**m, 'n': lambda q: q}",
                                   "match p:\n    case {'a': 1, **r}:\n        pass\n    case [_, *s]:\n        pass"]) for _ in range(30))
    tree = ast.parse(source)
    pre, last, order = extract._number(tree)
    assert [id(n) for n in order] == [id(n) for n in ast.walk(tree)]
    spans = []  # preorder walk: (kind, pre, last)

    def walk(node, n):
        at, end = n, n
        for child in ast.iter_child_nodes(node):
            end = walk(child, end + 1)
        spans.append((type(node).__name__, at, end))
        return end

    walk(tree, 0)
    assert sorted(spans) == sorted((type(n).__name__, p, l) for n, p, l in zip(order, pre, last))


def test_cached_facts_lie_sorted_by_node(files_df):
    t = run(files_df({f"m{i}.py": "import os\nfor i in x:\n    open(i)\n" for i in range(40)}))
    for rows in t.facts.select("node").rdd.glom().collect():
        nodes = [r.node for r in rows]
        assert nodes == sorted(nodes)


def test_cycle_search_broadcasts_nothing(spark, monkeypatch):
    plans = []
    write = graph.write_table

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "write_table", recorded)
    edges = [(f"m{i}.py", f"m{(i + 1) % 6}.py") for i in range(6)] + [("m6.py", "m0.py"), ("m2.py", "m0.py")]
    nodes = spark.createDataFrame([("r", f"m{i}.py") for i in range(7)], "repo string, path string")
    table = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, source string, target string")
    assert [r.evidence for r in graph.cycle_rows(nodes, table).collect()] == ["m0.py -> m1.py -> m2.py -> m0.py"]
    assert plans and not any("Broadcast" in p for p in plans)


def test_rules_that_count_files_read_no_import_graph(files_df):
    t = run(files_df({"a.py": "import b\n", "b.py": "", "tests/test_a.py": "def test_a():\n    pass\n"}))
    only = SimpleNamespace(parsed=t.parsed, repos=t.repos, targets=t.targets)
    cfg = SimpleNamespace(large_scope_files=2)
    assert [(r.path, r.evidence) for r in structure.large_review_scope(only, cfg).collect()] == [("a.py", ["file_count=3"])]
    assert coverage.no_tests(only, UNCAPPED).count() == 0
    assert [r.path for r in coverage.missing_targeted_test(only, UNCAPPED).collect()] == ["b.py"]


def test_degree_tasks_grow_with_lineitem(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 400, 1, 1).selectExpr("cast(id % 20 AS bigint) AS l_suppkey", "cast(id % 97 AS bigint) AS l_partkey")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(lane_d, "EDGES_PER_TASK", 20, raising=False)
    nodes, edges = lane_d._lineitem_graph(spark, str(tmp_path))[:2]
    assert _partitions(edges) == _partitions(nodes) == 20
    plan = lane_d.q_degree_topk(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    by_path = [line for line in plan.splitlines() if "Exchange hashpartitioning(repo" in line and "path" in line]
    assert by_path and all("REPARTITION_BY_NUM" in line for line in by_path)


def test_parsed_files_and_edges_broadcast_nothing(files_df):
    files = files_df({"a.py": "import b\n", "b.py": "def f():\n    pass\n"})
    t = analyze(files, None, UNCAPPED, persist_facts=False)
    assert [(r.source, r.target) for r in t.edges.collect()] == [("a.py", "b.py")]
    assert "Broadcast" not in t.edges._jdf.queryExecution().executedPlan().toString()


def _small_part(spark, tmp_path):
    spark.range(0, 60, 1, 2).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def _plan(df):
    """The plan as the driver holds it, what persisted tables were made by included."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_issue_summary_reads_issues_written_rule_by_rule(spark, tmp_path):
    sf = _small_part(spark, tmp_path)
    out = lane_c.q_issue_summary(spark, sf)
    assert "InMemoryTableScan" not in _plan(out) and len(_plan(out).splitlines()) < 40
    t = lane_c.corpus_tables(spark, sf)
    built = union_all(registry.built(t, t.cfg)).collect()
    assert sorted(map(str, t.raw_issues().collect())) == sorted(map(str, built))
    expected = Counter(x for r in built for x in ((r.repo, "agent", r.agent), (r.repo, "severity", r.severity), (r.repo, "total", "")))
    assert {(r.repo, r.dimension, r.key): r.n for r in out.collect()} == expected


def test_second_run_reads_issues_written_rule_by_rule(spark, tmp_path, monkeypatch):
    dropped = []
    monkeypatch.setattr(analyze_module, "delete_tables", lambda s, paths: dropped.extend(paths) or delete_tables(s, paths))
    out = lane_c.q_incremental_new_issues(spark, _small_part(spark, tmp_path))
    assert "InMemoryTableScan" not in _plan(out) and len(_plan(out).splitlines()) < 100
    assert len(dropped) > 10  # the first run's issues go once its history is written
    edited = [k for k in range(0, 60, 4) if k % 97 and k % 11 not in (1, 7)]
    assert sorted((r.path, r.rule_id) for r in out.collect()) == sorted((f"pkg0/m{k}.py", "security.dynamic-execution") for k in edited)


def test_file_suggestions_read_issues_written_rule_by_rule(spark, tmp_path):
    sf = _small_part(spark, tmp_path)
    out = lane_c.q_file_suggestions(spark, sf)
    t = lane_c.corpus_tables(spark, sf)
    context = sum("InMemoryTableScan" in line for line in _plan(t.file_contexts).splitlines())
    assert sum("InMemoryTableScan" in line for line in _plan(out).splitlines()) <= context  # no rule's
    rows, titles = out.collect(), Counter()
    for r in t.raw_issues().select("repo", "path", "title").collect():
        titles[r.repo, r.path, r.title] += 1
    assert Counter((r.repo, r.path, s) for r in rows for s in filter(None, r.suggestions.split(";"))) == titles
    assert len(rows) == t.parsed.count() and sum(r.issues for r in rows) == titles.total()


def test_unused_symbols_are_joined_once(files_df):
    t = run(files_df({"a.py": "import b\ndef F():\n    pass\nclass c:\n    pass\n", "b.py": "def used():\n    pass\n", "d.py": "used\n"}))
    found = structure.unused_symbols(t, UNCAPPED)
    assert [(r.rule_id, r.path, r.line, r.evidence[0], r.title) for r in found.orderBy("seq").collect()] == [
        ("structure.unused-function", "a.py", 2, "F", RULES["structure.unused-function"][0]),
        ("structure.unused-class", "a.py", 4, "c", RULES["structure.unused-class"][0])]
    assert len(re.findall(r"\bJoin LeftOuter,", found._jdf.queryExecution().optimizedPlan().toString())) == 3
