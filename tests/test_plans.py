"""Plan shape: containment rules are keyed joins, scans read only the columns they need."""

import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from corpuslint.functions.columns import globs_regex
from corpuslint.operators.rules import performance, security, structure
from tests.helpers import UNCAPPED, run

BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containment_rules_use_keyed_joins(files_df):
    t = run(files_df({"a.py": "def f():\n    for i in x:\n        open(i)\n        len(x)\n        len(x)\n"}))
    for df in (structure.complex_function(t, UNCAPPED), performance.loop_io(t, UNCAPPED),
               performance.repeated_len(t, UNCAPPED), security.sql_concat(t, UNCAPPED)):
        plan = _plan(df)
        assert not any(b in plan for b in BAD_JOINS), plan


def test_scans_prune_columns(spark):
    q = E.queries()
    plan = _plan(q["secret_lines"](spark, "/root/testdata/sf0.001"))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas)
    plan = _plan(q["degree_topk"](spark, "/root/testdata/sf0.001"))
    assert all(s == "struct<l_partkey:bigint,l_suppkey:bigint>" for s in re.findall(r"ReadSchema: (struct<[^>]*>)", plan))


_PIECE = st.sampled_from(["a", "b", "/", ".", "*", "?", "**/", "[ab]", "[!a]", "-", "py"])
_PATH = st.text(alphabet="ab/.-py", min_size=0, max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(_PIECE, min_size=1, max_size=5), _PATH)
def test_glob_regex_agrees_with_fnmatch(pieces, path):
    pattern = "".join(pieces)
    expected = fnmatch.fnmatchcase(path, pattern) or (pattern.startswith("**/") and fnmatch.fnmatchcase(path, pattern[3:]))
    rx = globs_regex([pattern]).replace("\\z", "\\Z").replace("(?s)", "")
    assert bool(re.match(rx, path, re.S)) == expected
