"""Parse job."""

from corpuslint.operators.extract import call_name, file_facts
from tests.helpers import run


def test_parse_failure_is_isolated(files_df):
    t = run(files_df({"good.py": "def ok():\n    return 1\n", "bad.py": "def broken(:\n"}))
    assert [r.path for r in t.parsed.collect()] == ["good.py"]
    failed = t.failed.collect()
    assert [(r.path, r.stage) for r in failed] == [("bad.py", "parse")]
    assert "bad.py" in failed[0].reason


def test_crlf_twin_hashes_equal_sizes_differ(files_df):
    t = run(files_df({"a.py": "x = 1\r\ny = 2\r\n", "b.py": "x = 1\ny = 2\n"}))
    rows = {r.path: r for r in t.parsed.collect()}
    assert rows["a.py"].content_hash == rows["b.py"].content_hash
    assert rows["a.py"].size_bytes != rows["b.py"].size_bytes


def test_bad_bytes_bom_nul_fail_alone(files_df):
    t = run(files_df({"inv.py": b"\xff\xfe x", "bom.py": "\ufeffx = 1\n".encode("utf-8"),
                      "nul.py": b"x = 1\x00\n", "ok.py": "x = 1\n"}))
    assert {r.path for r in t.parsed.collect()} == {"ok.py"}
    failed = {r.path: r.reason for r in t.failed.collect()}
    assert set(failed) == {"inv.py", "bom.py", "nul.py"}
    assert "can't decode byte 0xff" in failed["inv.py"]


def test_imports_symbols_and_params(files_df):
    src = ("from .x import y\nfrom . import z\nimport a.b as c, d\n"
           "def f(self, a, *args, b=1, **kw):\n    pass\n"
           "async def g():\n    pass\n"
           "class K:\n    def m(self):\n        pass\n")
    t = run(files_df({"p.py": src}))
    row = t.parsed.collect()[0]
    assert row.imports == ["a.b", "d", "x"]
    assert [(f.name, f.parameter_count, f.line_start) for f in row.functions] == [("f", 2, 4), ("m", 1, 9)]
    assert [(c.name, c.line_start, c.line_end) for c in row.classes] == [("K", 8, 10)]


def test_nested_set_and_bfs_numbering():
    src = "def f():\n    for i in x:\n        open(i)\nopen(1)\n"
    facts = file_facts("r", "p.py", src, len(src), "h")
    cols = ["repo", "path", "pre", "last", "bfs", "idx", "node", "line"]
    rows = [dict(zip(cols, r[:8])) for r in facts]
    fn = next(r for r in rows if r["node"] == "FunctionDef")
    loop = next(r for r in rows if r["node"] == "For")
    calls = [r for r in rows if r["node"] == "Call"]
    inside = [c for c in calls if loop["pre"] <= c["pre"] <= loop["last"]]
    assert [c["line"] for c in inside] == [3]
    assert fn["pre"] < loop["pre"] <= loop["last"] <= fn["last"]
    assert min(c["bfs"] for c in calls) == next(c["bfs"] for c in calls if c["line"] == 4)  # shallower first


def test_call_name_unknown_base():
    import ast
    assert call_name(ast.parse("f().eval(x)").body[0].value.func) == "eval"
    assert call_name(ast.parse("df.eval(x)").body[0].value.func) == "df.eval"
    assert call_name(ast.parse("a.b.c()").body[0].value.func) == "a.b.c"
    assert call_name(ast.parse("(lambda: 1)()").body[0].value.func) is None


def test_surrogate_literal_fails_alone(files_df):
    t = run(files_df({"good.py": "x = 1\n", "odd.py": "x = '\\ud800'\n"}))
    assert [r.path for r in t.parsed.collect()] == ["good.py"]
    assert [(r.path, r.stage) for r in t.failed.collect()] == [("odd.py", "parse")]
