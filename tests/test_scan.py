"""Admission (A2-A10) and source-reference helpers."""

from pyspark.sql import functions as F

from corpuslint.config import Settings
from corpuslint.functions.columns import classify_error, globs_regex, is_remote_ref, normalize_ref, path_key
from corpuslint.operators.scan import admit


def decisions(spark, rows, cfg):
    df = spark.createDataFrame([("r", p, s) for p, s in rows], "repo string, path string, size_bytes bigint")
    return {r.path: r.skip_rule for r in admit(df, cfg).collect()}


def test_greedy_budget_skips_then_fits(spark):
    d = decisions(spark, [("a.py", 3), ("b.py", 9), ("c.py", 2)], Settings(max_total_bytes=6))
    assert d == {"a.py": None, "b.py": "max_total_bytes", "c.py": None}


def test_file_count_cap_counts_accepted_files(spark):
    d = decisions(spark, [("a.py", 1), ("b.py", 100), ("c.py", 1), ("d.py", 1)], Settings(max_files=2, max_total_bytes=50))
    assert d == {"a.py": None, "b.py": "max_total_bytes", "c.py": None, "d.py": "max_files"}


def test_globs_are_root_anchored_and_star_crosses_slash(spark):
    rows = [("node_modules/x.js", 1), ("x/node_modules/y.js", 1), ("deep/a/b/c.ts", 1), ("README.md", 1),
            ("build/out.py", 1), (".code-review-history.json", 1)]
    d = decisions(spark, rows, Settings())
    assert d["node_modules/x.js"] == "exclude"
    assert d["x/node_modules/y.js"] is None
    assert d["deep/a/b/c.ts"] is None
    assert d["README.md"] == "include"
    assert d["build/out.py"] == "exclude"
    assert ".code-review-history.json" not in d  # the history file is neither scanned nor reported


def test_size_cap_and_language(spark):
    df = spark.createDataFrame([("r", "big.py", 300_000), ("r", "A.java", 5), ("r", "x.PY", 5)],
                               "repo string, path string, size_bytes bigint")
    out = {r.path: (r.skip_rule, r.language) for r in admit(df, Settings(include_globs=("**/*",), max_file_bytes=200_000)).collect()}
    assert out["big.py"] == ("max_file_bytes", "python")
    assert out["A.java"] == (None, "java")
    assert out["x.PY"] == (None, "text")  # suffix lookup is case-sensitive


def test_glob_translation():
    import re
    rx = globs_regex(["**/*.py", "src/[!t]*.js", "a?c"])
    py = re.compile(rx.replace("\\z", "\\Z").replace("(?s)", ""), re.S)
    assert py.match("x.py") and py.match("a/b/x.py")
    assert py.match("src/app.js") and not py.match("src/test.js")
    assert py.match("abc") and not py.match("abbc")


def test_component_path_order(spark):
    df = spark.createDataFrame([("a-b.py",), ("a/b.py",)], "path string")
    assert [r.path for r in df.orderBy(path_key("path")).collect()] == ["a/b.py", "a-b.py"]


def test_reference_helpers(spark):
    df = spark.createDataFrame([("https://github.com/org/repo",), ("git@host:x.git",), ("/local/path",)], "ref string")
    out = df.select(normalize_ref(F.col("ref")).alias("n"), is_remote_ref(F.col("ref")).alias("r")).collect()
    assert out[0].n == "https://github.com/org/repo.git" and out[0].r
    assert out[1].r and not out[2].r
    msgs = spark.createDataFrame([("ERROR: Repository not found.",), ("fatal: Permission denied (publickey)",),
                                  ("remote branch x not found",), ("weird",)], "m string")
    cats = [r.c for r in msgs.select(classify_error(F.col("m")).alias("c")).collect()]
    assert cats == ["repository_not_found", "permission_denied", "repository_not_found", "unknown"]


def test_directory_source(spark, tmp_path):
    from corpuslint.sources.files import list_directory, read_directory
    for repo, rel, text in [("r1", "main.py", "x = 1\n"), ("r1", "pkg/a.py", "y = 2\n"), ("r2", "b.js", "z\n"),
                            ("r2", "big.py", "#" * 500 + "\n")]:
        p = tmp_path / repo / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = {(r.repo, r.path): r.size_bytes for r in read_directory(spark, str(tmp_path), max_file_bytes=100).collect()}
    assert rows == {("r1", "main.py"): 6, ("r1", "pkg/a.py"): 6, ("r2", "b.js"): 2, ("r2", "big.py"): 501}
    big = read_directory(spark, str(tmp_path), max_file_bytes=100).where("path = 'big.py'").collect()[0]
    assert big.content is None  # its bytes are not read; admission reports it
    listed = {(r.repo, r.path) for r in list_directory(spark, str(tmp_path)).collect()}
    assert ("r2", "big.py") in listed
    one = {r.path for r in read_directory(spark, str(tmp_path / "r1"), repo="solo").collect()}
    assert one == {"main.py", "pkg/a.py"}


def test_directory_source_keeps_every_name(spark, tmp_path):
    from corpuslint.sources.files import read_directory
    names = ["r/main.py", "r/app/__init__.py", "r/app/h.py", "r/app/_util.py", "r/_priv/a.py", "r/.x/deep/er/b.py", "top.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {(r.repo, r.path): bytes(r.content).decode() for r in read_directory(spark, root).collect()}
        assert got == {((".", n) if "/" not in n else tuple(n.split("/", 1))): f"# {n}\n" for n in names}


def test_fitting_repo_skips_fold_overflowing_repo_folds(spark):
    rows = [("small", "a.py", 2), ("small", "b.py", 2), ("big", "a.py", 3), ("big", "b.py", 9), ("big", "c.py", 2)]
    df = spark.createDataFrame(rows, "repo string, path string, size_bytes bigint")
    out = {(r.repo, r.path): r.skip_rule for r in admit(df, Settings(max_total_bytes=6)).collect()}
    assert out == {("small", "a.py"): None, ("small", "b.py"): None,
                   ("big", "a.py"): None, ("big", "b.py"): "max_total_bytes", ("big", "c.py"): None}


def test_nothing_is_dropped_by_default(spark):
    df = spark.createDataFrame([("r", f"m{i}.py", 300_000) for i in range(600)], "repo string, path string, size_bytes bigint")
    assert admit(df, Settings()).where("skip_rule is null").count() == 600


def _greedy(rows, max_files, max_bytes):
    out, by = {}, {}
    for repo, path, size in rows:
        by.setdefault(repo, []).append((path.split("/"), path, size))
    for repo, files in by.items():
        count = total = 0
        for _, path, size in sorted(files):
            if max_files is not None and count >= max_files:
                out[repo, path] = "max_files"
            elif max_bytes is not None and total + size > max_bytes:
                out[repo, path] = "max_total_bytes"
            else:
                out[repo, path] = None
                count, total = count + 1, total + size
    return out


def test_budget_phases_match_the_plain_fold(spark):
    """Many repositories, one of them spread over many buckets, under byte and count caps."""
    import random

    from corpuslint.operators.budget import budget_decisions
    rnd = random.Random(1)
    rows = [(f"r{g}", f"d{rnd.randint(0, 9)}/f{i}.py", rnd.choice([0, rnd.randint(0, hi), rnd.randint(0, hi)]))
            for g in range(40) for hi in [rnd.choice([1, 3, 10, 1000])] for i in range(rnd.randint(1, 40))]
    rows += [("hot", f"d{i % 7}/f{i}.py", rnd.randint(0, 50)) for i in range(1500)]
    df = spark.createDataFrame(rows, "repo string, path string, size_bytes bigint").repartition(4)
    for max_files, max_bytes, bits in ((None, 100, 3), (9, 150, 14), (400, 9000, 5), (0, 10, 14), (None, 0, 14)):
        got = {(r.repo, r.path): r.skip_rule for r in budget_decisions(df, max_files, max_bytes, bits).collect()}
        assert got == _greedy(rows, max_files, max_bytes)


def test_a_size_that_is_not_known_is_a_skip_reason(spark):
    d = decisions(spark, [("a.py", 3), ("b.py", None), ("c.py", 9)], Settings(max_total_bytes=6))
    assert d == {"a.py": None, "b.py": "size_unknown", "c.py": "max_total_bytes"}
    assert decisions(spark, [("a.py", None)], Settings()) == {"a.py": None}
