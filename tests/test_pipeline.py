"""End-to-end on the sample repository; incremental runs and history modes."""

from corpuslint.config import Settings
from tests.helpers import run

SAMPLE = {
    "main.py": "from app.service import Service\n\n\ndef run():\n    return Service().handle()\n",
    "app/__init__.py": "",
    "app/service.py": "from app.helpers import format_name\n\n\nclass Service:\n    def handle(self):\n"
                      "        return format_name('x')\n",
    "app/helpers.py": "def format_name(name):\n    return name.title()\n",
}


def test_sample_repository(files_df):
    t = run(files_df(SAMPLE))
    assert t.parsed.count() == 4
    edges = {(r.source, r.target, r.resolved) for r in t.edges.collect()}
    assert ("main.py", "app/service.py", True) in edges
    assert ("app/service.py", "app/helpers.py", True) in edges
    keys = t.key_files.orderBy("rank").collect()
    assert keys[0].path == "main.py" and keys[0].reason.startswith("entrypoint")
    assert {r.status for r in t.changes.collect()} == {"changed"}
    assert t.budget.collect()[0].within_budget
    order = [r.path for r in t.highlighted.orderBy("rank").collect()]
    assert order == ["app/__init__.py", "app/helpers.py", "app/service.py", "main.py"]


def test_package_module_collision_last_wins(files_df):
    t = run(files_df({"pkg.py": "x = 1\n", "pkg/__init__.py": "", "use.py": "import pkg\n"}))
    e = [r for r in t.edges.collect() if r.source == "use.py"]
    assert e[0].target == "pkg.py"


def test_two_runs_changed_then_unchanged(files_df):
    files = files_df({"a.py": "password = 'hunter2'\n"})
    t1 = run(files)
    h1 = t1.next_history()
    t2 = run(files, history=h1)
    assert [r.status for r in t2.changes.collect()] == ["unchanged"]
    # nothing changed: target stays every file
    assert [r.path for r in t2.targets.collect()] == ["a.py"]


def _three_runs(files, mode):
    cfg = Settings(max_files=None, max_total_bytes=None, history_mode=mode)
    counts, history = [], None
    for _ in range(3):
        t = run(files, cfg, history)
        counts.append(len(issues_of_new(t)))
        history = _materialise(t.next_history())
    return counts


def issues_of_new(t):
    return t.issues().filter("rule_id = 'security.hardcoded-secret'").collect()


def _materialise(df):
    from corpuslint.session import cut_lineage
    return cut_lineage(df)


def test_history_union_vs_replace(files_df):
    files = files_df({"s.py": "API_KEY = 'abc'\n"})
    assert _three_runs(files, "union") == [1, 0, 0]
    assert _three_runs(files, "replace") == [1, 0, 1]


def test_summary_mode_prunes_context_after_budget(files_df):
    cfg = Settings(max_files=None, max_total_bytes=None, summary_only=True)
    t = run(files_df(SAMPLE), cfg)
    assert t.key_files.count() == 0 and t.focus.count() == 0 and t.highlighted.count() == 0
    assert t.budget.collect()[0].estimated_tokens > 4 * 40  # computed from unpruned inputs
    fams = {r.agent for r in t.raw_issues().select("agent").distinct().collect()}
    assert fams <= {"structure", "security", "test"}


def test_repo_independence(files_df):
    a = {"a.py": "import b\n", "b.py": "import a\nAPI_KEY = 'k'\n"}
    b = {"main.py": "def F():\n    pass\n"}
    both = run(files_df({"ra": a, "rb": b}))
    ia = run(files_df(a, repo="ra"))
    ib = run(files_df(b, repo="rb"))
    key = lambda rows: sorted((r.repo, r.rule_id, r.path, r.line) for r in rows)
    assert key(both.raw_issues().collect()) == key(ia.raw_issues().collect() + ib.raw_issues().collect())
