"""Test-coverage-by-name rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.config import TEST_SCAN_HEURISTIC
from corpuslint.functions.columns import basename, expected_test_names, is_test_file, path_key
from corpuslint.operators.issues import make_issues, seq


def no_tests(t, cfg) -> DataFrame:
    per_repo = t.parsed.groupBy("repo").agg(
        F.max(is_test_file(F.col("path")).cast("int")).alias("has_test"),
        F.min_by("path", path_key("path")).alias("first"))
    repos = t.repos.join(per_repo, ["repo"], "left")
    hit = repos.filter(F.coalesce(F.col("has_test"), F.lit(0)) == 0)
    first = F.coalesce(F.col("first"), F.lit("."))
    return make_issues(hit, "test.no-tests-detected", path=first, line=None,
                       evidence=F.array(F.lit(TEST_SCAN_HEURISTIC)), order=seq("test", 0, first))


def missing_targeted_test(t, cfg) -> DataFrame:
    tests = (t.parsed.filter(is_test_file(F.col("path")))
             .select("repo", basename(F.col("path")).alias("expected")).distinct())
    targets = t.targets.filter(~is_test_file(F.col("path")) & (F.col("path") != "__init__.py")
                               & ~F.col("path").endswith("/__init__.py"))
    targets = targets.withColumn("expected_names", expected_test_names(F.col("path")))
    mapped = (targets.select("repo", "path", F.explode("expected_names").alias("expected"))
                     .join(tests, ["repo", "expected"], "left_semi").select("repo", "path").distinct())
    hit = targets.join(mapped, ["repo", "path"], "left_anti")
    return make_issues(hit, "test.missing-targeted-test", path=F.col("path"), line=None,
                       evidence=F.array(F.concat(F.lit("expected_tests="), F.array_join("expected_names", ","))),
                       order=seq("test", 1, F.col("path")))


RULES = [
    (("test.no-tests-detected",), no_tests),
    (("test.missing-targeted-test",), missing_targeted_test),
]
