"""Column-expression helpers. All of them build JVM-side expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslint import config as C

# Python's str.splitlines() boundaries (after \r\n and \r were folded to \n).
SPLITLINES_REGEX = "[\\n\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
# Python's str.isspace() set, spelled out so \s means the same in every engine.
PY_WHITESPACE_CLASS = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SECRET_REGEX = (
    "(?iu)" + C.SECRET_KEYWORDS + PY_WHITESPACE_CLASS + "*=" + PY_WHITESPACE_CLASS + "*['\"][^'\"]+['\"]"
)


def glob_to_regex(pattern: str) -> str:
    """fnmatch-style glob -> Java regex body: '*' also crosses '/', '[!x]' negates."""
    out: list[str] = []
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            while i < n and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
                continue
            body = pattern[i:j]
            i = j + 1
            negate = body.startswith("!")
            if negate:
                body = body[1:]
            body = body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&\\&")
            if body.startswith("^"):
                body = "\\" + body
            out.append("[" + ("^" if negate else "") + body + "]")
        else:
            out.append(_escape(ch))
    return "".join(out)


def _escape(ch: str) -> str:
    return "\\" + ch if ch in ".^$|?*+()[]{}\\/-" else ch


def globs_regex(patterns: Iterable[str]) -> str | None:
    """One anchored regex for a glob list; a leading '**/' is also tried without it."""
    alts: list[str] = []
    for p in patterns:
        alts.append(glob_to_regex(p))
        if p.startswith("**/"):
            alts.append(glob_to_regex(p[3:]))
    if not alts:
        return None
    return "(?s)^(?:" + "|".join(alts) + ")\\z"


def matches_globs(col: Column, patterns: Iterable[str]) -> Column:
    rx = globs_regex(patterns)
    return F.lit(False) if rx is None else col.rlike(rx)


def path_key(path: Column | str = "path") -> Column:
    """Component-wise path order (Path sorting): 'a/b.py' sorts before 'a-b.py'."""
    return F.split(F.col(path) if isinstance(path, str) else path, "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent_name(path: Column) -> Column:
    """Name of the immediate parent directory ('' at top level)."""
    return F.regexp_extract(path, "(?:^|/)([^/]*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.left(name, F.length(name) - F.length(suffix_of(name)))


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(name, "^.+(\\.[^.]+)$", 1)


def language_of(path: Column) -> Column:
    suffix = suffix_of(basename(path))
    m = F.create_map(*[x for kv in C.LANGUAGE_BY_SUFFIX.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(m[suffix], F.lit("text"))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def content_hash(text: Column) -> Column:
    """SHA-1 hex of the newline-normalised text (what a text-mode read hashes)."""
    return F.sha1(F.encode(normalize_newlines(text), "UTF-8"))


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, "^" + PY_WHITESPACE_CLASS + "+|" + PY_WHITESPACE_CLASS + "+$", "")


def is_test_file(path: Column) -> Column:
    return path.startswith("tests/") | path.startswith("test_") | path.contains("/test_")


def expected_test_names(path: Column) -> Column:
    s = stem(path)
    parent = parent_name(path)
    return F.array_compact(
        F.array(
            F.concat(F.lit("test_"), s, F.lit(".py")),
            F.concat(s, F.lit("_test.py")),
            F.when((parent != "") & (parent != "."), F.concat(F.lit("test_"), parent, F.lit("_"), s, F.lit(".py"))),
        )
    )


def fingerprint(path: Column, title: Column) -> Column:
    return F.concat(path, F.lit(":"), F.lower(py_strip(title)))


def severity_rank(sev: Column) -> Column:
    m = F.create_map(*[x for kv in C.SEVERITY_ORDER.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[sev]


def agent_of(rule_id: Column) -> Column:
    return F.substring_index(rule_id, ".", 1)


def sarif_level(sev: Column) -> Column:
    m = F.create_map(*[x for kv in C.SARIF_LEVEL.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[sev]


def is_remote_ref(ref: Column) -> Column:
    cond = F.lit(False)
    for p in C.REMOTE_REF_PREFIXES:
        cond = cond | ref.startswith(p)
    return cond


def normalize_ref(ref: Column) -> Column:
    gh = F.lit(False)
    for p in C.GITHUB_HTTP_PREFIXES:
        gh = gh | ref.startswith(p)
    return F.when(gh & ~ref.endswith(".git"), F.concat(ref, F.lit(".git"))).otherwise(ref)


def classify_error(msg: Column) -> Column:
    low = F.lower(msg)
    expr = None
    for category, needles in C.CLONE_ERROR_CATEGORIES:
        cond = F.lit(False)
        for n in needles:
            cond = cond | low.contains(n)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit("unknown"))


def rule_literals(rule_id: str) -> list[Column]:
    """title, description, severity, confidence literals of one catalogue rule."""
    title, desc, sev, conf = C.RULES[rule_id]
    return [
        F.lit(rule_id).alias("rule_id"),
        F.lit(title).alias("title"),
        F.lit(desc).alias("description"),
        F.lit(sev).alias("severity"),
        F.lit(conf).cast("double").alias("confidence"),
    ]
