"""Parse and extract (B1-B9, G8): one pass over content turns accepted files into flat facts.

Every accepted file's bytes go once through one ``mapInArrow`` stage. It decodes them
strictly, hashes the newline-normalised text, parses Python sources with the stdlib
``ast`` module and emits rows tagged by ``node``:

* ``Module`` for a parsed Python file, ``Text`` for a file of another language;
* ``__undecodable__`` (not read, not UTF-8) and ``__error__`` (does not parse), with the reason;
* the node kinds some rule reads; of string literals only that an SQL one stands there
  (``SqlStr``), never its text; and a ``Secret`` row for each line that holds one.

Nodes are numbered so that every later rule is a DataFrame sweep or aggregate:

* ``pre``/``last``: nested-set numbering; x is inside y  <=>  y.pre <= x.pre <= y.last
* ``bfs``: position in breadth-first (``ast.walk``) order
"""

from __future__ import annotations

import ast
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint import config as C

FACTS_SCHEMA = (
    "repo string, path string, pre int, last int, bfs int, idx int, node string, line int, end_line int, "
    "name string, call_name string, module string, n_params int, shell_true boolean, loader_name string, "
    "text string, size_bytes bigint, content_hash string, language string"
)
FACT_COLUMNS = [c.split()[0] for c in FACTS_SCHEMA.split(", ")]

_SECRET = re.compile("(?i)" + C.SECRET_KEYWORDS + r"\s*=\s*['\"][^'\"]+['\"]")

_BRANCH = {ast.If: "If", ast.For: "For", ast.While: "While", ast.Try: "Try"}
if hasattr(ast, "Match"):
    _BRANCH[ast.Match] = "Match"
#: The kinds of nodes that make a row.
_READ = {*_BRANCH, ast.FunctionDef, ast.ClassDef, ast.Call, ast.Import, ast.ImportFrom, ast.Name, ast.BinOp, ast.Constant}
#: Per kind of node the fields that can hold nodes: all but names, numbers and literals.
_CHILDREN = {kind: tuple(f for f in kind._fields if getattr(kind, "_field_types", {}).get(f) not in (str, str | None, int, int | None, object))
             for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) and ast.Constant not in kind.__bases__}


def call_name(node: ast.AST) -> str | None:
    """Dotted name of a call target; an unknown base keeps only the attribute path."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    elif not parts:
        return None
    return ".".join(reversed(parts))


def _number(tree: ast.AST) -> tuple[list[int], list[int], list[ast.AST]]:
    """pre, last and node at each place of breadth-first (ast.walk) order.

    A node's children stand side by side in that order, so sizes of subtrees are summed
    from the end and preorder numbers dealt from the start, both by place alone.
    """
    order: list[ast.AST] = [tree]
    parent = [0]
    for b, node in enumerate(order):
        if not node._fields:  # a context or an operator
            continue
        known = len(order)
        for name in _CHILDREN[type(node)]:
            value = getattr(node, name, None)
            if isinstance(value, list):
                order.extend([item for item in value if isinstance(item, ast.AST)])
            elif isinstance(value, ast.AST):
                order.append(value)
        parent.extend([b] * (len(order) - known))
    size = [1] * len(order)
    for b in range(len(order) - 1, 0, -1):
        size[parent[b]] += size[b]
    pre = [0] * len(order)
    free = [1] * len(order)  # the number that a node's next child gets
    for b in range(1, len(order)):
        p = parent[b]
        pre[b] = free[p]
        free[b] = pre[b] + 1
        free[p] += size[b]
    return pre, [p + n - 1 for p, n in zip(pre, size)], order


def file_facts(repo: str, path: str, text: str, size_bytes: int, chash: str) -> list[tuple]:
    """Fact rows of one Python file, or a single ``__error__`` row if it does not parse."""
    def row(node_kind, pre=None, last=None, bfs=None, idx=None, line=None, end_line=None, name=None,
            cname=None, module=None, n_params=None, shell=None, loader=None, txt=None, size=None, h=None):
        return (repo, path, pre, last, bfs, idx, node_kind, line, end_line, name, cname, module, n_params,
                shell, loader, txt, size, h, "python")

    try:
        tree = ast.parse(text, filename=path)
        pre, last, order = _number(tree)
    except Exception as exc:  # any failure isolates this file only
        return [row("__error__", txt=str(exc), size=size_bytes, h=chash)]

    out = [row("Module", 0, last[0], 0, size=size_bytes, h=chash)]
    seen_names: set[str] = set()
    for b, node in enumerate(order):
        kind = type(node)
        if kind not in _READ:
            continue
        p, l = pre[b], last[b]
        if kind is ast.FunctionDef:
            out.append(row("FunctionDef", p, l, b, line=node.lineno, end_line=getattr(node, "end_lineno", node.lineno),
                           name=node.name, n_params=len(node.args.args)))
        elif kind is ast.ClassDef:
            out.append(row("ClassDef", p, l, b, line=node.lineno, end_line=getattr(node, "end_lineno", node.lineno),
                           name=node.name))
        elif kind in _BRANCH:
            out.append(row(_BRANCH[kind], p, l, b, line=node.lineno))
        elif kind is ast.Call:
            shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True
                        for k in node.keywords)
            loader = next((call_name(k.value) for k in node.keywords if k.arg == "Loader"), None)
            bare = node.func.id if isinstance(node.func, ast.Name) else None
            out.append(row("Call", p, l, b, line=node.lineno, name=bare, cname=call_name(node.func),
                           shell=shell, loader=loader))
        elif kind is ast.Import:
            for j, alias in enumerate(node.names):
                out.append(row("Import", p, l, b, j, line=node.lineno,
                               name=alias.asname or alias.name.split(".")[-1], module=alias.name))
        elif kind is ast.ImportFrom:
            for j, alias in enumerate(node.names):
                out.append(row("ImportFrom", p, l, b, j, line=node.lineno,
                               name=alias.asname or alias.name, module=node.module))
        elif kind is ast.Name:
            if node.id not in seen_names:  # rules only ask whether a name occurs in the file
                seen_names.add(node.id)
                out.append(row("Name", p, l, b, name=node.id))
        elif kind is ast.BinOp and isinstance(node.op, ast.Add):
            out.append(row("AddOp", p, l, b, line=node.lineno))
        elif kind is ast.Constant and isinstance(node.value, str):
            try:  # a literal may hold what no text column can (a lone surrogate)
                node.value.encode("utf-8")
            except UnicodeEncodeError as exc:
                return [row("__error__", txt=str(exc), size=size_bytes, h=chash)]
            upper = node.value.upper()
            if any(k in upper for k in C.SQL_KEYWORDS):
                out.append(row("SqlStr", p, l, b, line=node.lineno))
    if _SECRET.search(text):  # a line that matches does so within the text
        for n, line in enumerate(text.splitlines(), start=1):
            if _SECRET.search(line):
                out.append(row("Secret", line=n, txt=line.strip()))
    return out


def content_rows(repo: str, path: str, language: str, content: bytes | None, size_bytes: int | None,
                 unread: str | None) -> list[tuple]:
    """The rows of one accepted file; whatever is wrong with it, it fails alone and by one row."""
    def alone(node: str, text: str | None = None, chash: str | None = None) -> list[tuple]:
        return [(repo, path, None, None, None, None, node, None, None, None, None, None, None, None, None, text,
                 size_bytes, chash, language)]

    if content is None:
        return alone("__undecodable__", unread or "content is null")
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as exc:
        return alone("__undecodable__", str(exc))
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    chash = hashlib.sha1(text.encode("utf-8")).hexdigest()
    if language != "python":
        return alone("Text", chash=chash)
    return file_facts(repo, path, text, size_bytes, chash)


_ARROW_TYPES = None


def _arrow_schema():
    import pyarrow as pa
    global _ARROW_TYPES
    if _ARROW_TYPES is None:
        types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
        _ARROW_TYPES = pa.schema([(c.split()[0], types[c.split()[1]]) for c in FACTS_SCHEMA.split(", ")])
    return _ARROW_TYPES


def _facts_batches(batches):
    """Arrow in, Arrow out: columns go straight into Arrow arrays (no pandas frames)."""
    import pyarrow as pa
    schema = _arrow_schema()
    for batch in batches:
        cols = batch.to_pydict()
        rows: list[tuple] = []
        for args in zip(*(cols[c] for c in ("repo", "path", "language", "content", "size_bytes", "read_error"))):
            rows.extend(content_rows(*args))
        if not rows:
            continue
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[i], type=schema.field(i).type) for i in range(len(schema))], schema=schema)


def extract_facts(accepted: DataFrame, parse_partitions: int | None = None) -> DataFrame:
    """One pass over content -> ast_facts (with Module, Text and failure rows).

    A large file table arrives in many scan partitions and is parsed where it
    lies (no content shuffle). ``parse_partitions`` spreads a small table of
    large texts over more tasks first.
    """
    unread = F.col("read_error") if "read_error" in accepted.columns else F.lit(None).cast("string").alias("read_error")
    rows = accepted.select("repo", "path", "language", F.col("content").cast("binary").alias("content"), "size_bytes", unread)
    if parse_partitions:
        rows = rows.repartition(parse_partitions, "repo", "path")
    return rows.mapInArrow(_facts_batches, FACTS_SCHEMA)


def parsed_files(facts: DataFrame) -> DataFrame:
    """parsed_files: Python files that parsed (symbols from facts) plus text-mode files."""
    symbols = facts.filter(F.col("node").isin("FunctionDef", "ClassDef", "Import", "ImportFrom"))
    fn = F.struct(F.col("line").alias("line_start"), F.col("name"), F.lit("function").alias("kind"),
                  F.col("end_line").alias("line_end"), F.col("n_params").alias("parameter_count"))
    cl = F.struct(F.col("line").alias("line_start"), F.col("name"), F.lit("class").alias("kind"),
                  F.col("end_line").alias("line_end"), F.lit(None).cast("int").alias("parameter_count"))
    per_file = symbols.groupBy("repo", "path").agg(
        F.array_sort(F.array_distinct(F.collect_list(
            F.when(F.col("node").isin("Import", "ImportFrom"), F.col("module"))))).alias("imports"),
        F.array_sort(F.collect_list(F.when(F.col("node") == "FunctionDef", fn))).alias("functions"),
        F.array_sort(F.collect_list(F.when(F.col("node") == "ClassDef", cl))).alias("classes"),
    )
    reorder = "transform({c}, s -> named_struct('name', s.name, 'kind', s.kind, 'line_start', s.line_start, " \
              "'line_end', s.line_end, 'parameter_count', s.parameter_count))"
    empty_sym = F.expr("cast(array() as array<struct<name:string,kind:string,line_start:int,line_end:int,parameter_count:int>>)")
    modules = facts.filter(F.col("node") == "Module").select(
        "repo", "path", F.lit("python").alias("language"), F.lit("ast").alias("parse_mode"), "size_bytes", "content_hash")
    py = modules.join(per_file.hint("merge"), ["repo", "path"], "left").select(  # both grow with the files: never through the driver
        "repo", "path", "language", "parse_mode", "size_bytes", "content_hash",
        F.coalesce("imports", F.expr("cast(array() as array<string>)")).alias("imports"),
        F.coalesce(F.expr(reorder.format(c="functions")), empty_sym).alias("functions"),
        F.coalesce(F.expr(reorder.format(c="classes")), empty_sym).alias("classes"),
    )
    text = facts.filter(F.col("node") == "Text").select(
        "repo", "path", "language", F.lit("text").alias("parse_mode"), "size_bytes", "content_hash",
        F.expr("cast(array() as array<string>)").alias("imports"), empty_sym.alias("functions"),
        empty_sym.alias("classes"))
    return py.unionByName(text)


def parse_failures(facts: DataFrame) -> DataFrame:
    """Files that could not be read, decoded or parsed: each one row at stage `parse`."""
    return facts.filter(F.col("node").isin("__undecodable__", "__error__")).select(
        "repo", "path", F.col("text").alias("reason"), F.lit("parse").alias("stage"))
