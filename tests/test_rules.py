"""Rule families on small inline trees (the reference's agent cases plus quirks)."""

from tests.helpers import issues_of, rule_ids, run

SECURITY_STYLE = '''import pickle
API_TOKEN = "abc123"

def BadName(a, b, c, d, e, f):
    eval("1 + 1")
    return pickle.loads(a)

class lower_case:
    pass
'''


def test_security_and_style_ids(files_df):
    ids = rule_ids(run(files_df({"svc.py": SECURITY_STYLE})))
    assert {"security.hardcoded-secret", "security.dynamic-execution", "security.insecure-deserialization",
            "style.function-name", "style.too-many-parameters", "style.class-name"} <= ids


SQL_YAML = '''import random, tempfile, yaml

def q(user):
    sql = "SELECT * FROM t WHERE id = " + user
    data = yaml.load(open("x"))
    safe = yaml.load(open("x"), Loader=yaml.SafeLoader)
    name = tempfile.mktemp()
    return random.randint(1, 9), sql, data, safe, name
'''


def test_sql_yaml_mktemp_random(files_df):
    t = run(files_df({"q.py": SQL_YAML}))
    ids = rule_ids(t)
    assert {"security.sql-string-concat", "security.unsafe-yaml-load", "security.tempfile-mktemp",
            "security.weak-random"} <= ids
    assert len(issues_of(t, "security.unsafe-yaml-load")) == 1  # the SafeLoader call is fine


def test_cycle_two_files(files_df):
    t = run(files_df({"a.py": "import b\n", "b.py": "import a\n"}))
    cyc = issues_of(t, "structure.circular-dependency")
    assert len(cyc) == 1
    assert cyc[0]["path"] == "a.py" and cyc[0]["evidence"] == ["a.py -> b.py -> a.py"]


def test_self_import_is_a_cycle_with_degree_two(files_df):
    t = run(files_df({"a.py": "import a\n"}))
    assert issues_of(t, "structure.circular-dependency")[0]["evidence"] == ["a.py -> a.py"]
    k = t.key_files.collect()[0]
    assert k.path == "a.py" and k.score == 2 + 1  # degree 2 (source and resolved target) + top level


def test_complexity_and_unused_import(files_df):
    body = "".join(f"    if x == {i}:\n        y = {i}\n" for i in range(9))
    src = "import os\n\ndef busy(x):\n    y = 0\n" + body + "    return y\n"
    t = run(files_df({"c.py": src}))
    cx = issues_of(t, "structure.complex-function")
    assert len(cx) == 1 and cx[0]["evidence"] == ["function=busy", "branch_nodes=9"]
    assert [i["evidence"] for i in issues_of(t, "structure.unused-import")] == [["os"]]


def test_dotted_import_binds_last_component(files_df):
    t = run(files_df({"m.py": "import a.b\na.b.f()\n"}))
    assert [i["evidence"] for i in issues_of(t, "structure.unused-import")] == [["b"]]


def test_dead_code_and_single_file_exemption(files_df):
    t = run(files_df({"a.py": "def helper():\n    pass\nclass Thing:\n    pass\n", "b.py": "x = 1\n"}))
    assert {"structure.unused-function", "structure.unused-class"} <= rule_ids(t)
    single = run(files_df({"solo.py": "def helper():\n    return 1\n\nhelper()\n"}))
    assert not issues_of(single, "structure.unused-function")


def test_cross_file_use_by_import_binding(files_df):
    t = run(files_df({"lib.py": "def util():\n    pass\n", "app.py": "from lib import util\n"}))
    assert not issues_of(t, "structure.unused-function")


def test_targeted_test_mapping_and_init_skip(files_df):
    t = run(files_df({"service.py": "x = 1\n", "tests/test_other.py": "def test_x():\n    pass\n"}))
    miss = issues_of(t, "test.missing-targeted-test")
    assert [m["path"] for m in miss] == ["service.py"]
    assert miss[0]["evidence"] == ["expected_tests=test_service.py,service_test.py"]
    t2 = run(files_df({"pkg/__init__.py": ""}))
    assert not issues_of(t2, "test.missing-targeted-test")
    assert issues_of(t2, "test.no-tests-detected")[0]["path"] == "pkg/__init__.py"


def test_loop_rules_bag_semantics(files_df):
    src = ("import requests\n"
           "for u in urls:\n"
           "    for v in u:\n"
           "        requests.get(v)\n"
           "        n = len(u) + len(v)\n")
    t = run(files_df({"l.py": src}))
    io = issues_of(t, "performance.loop-io")
    assert len(io) == 2 and {i["line"] for i in io} == {4}  # once per enclosing loop
    ln = issues_of(t, "performance.repeated-len-call")
    assert len(ln) == 2 and {i["line"] for i in ln} == {5}


def test_sql_concat_fires_per_binop(files_df):
    t = run(files_df({"s.py": "q = 'SELECT ' + a + b\n"}))
    assert len(issues_of(t, "security.sql-string-concat")) == 2


def test_large_scope_and_budget(files_df):
    tree = {f"m{i}.py": "x = 1\n" for i in range(21)}
    t = run(files_df(tree))
    scope = issues_of(t, "structure.large-review-scope")
    assert scope[0]["path"] == "m0.py" and scope[0]["evidence"] == ["file_count=21"]
    b = t.budget.collect()[0]
    assert b.within_budget and b.estimated_tokens > 21 * 40
