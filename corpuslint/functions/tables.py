"""O3: the parse stage as a table function, for SQL over any table of sources.

``ast_facts(content)`` gives one row for each fact of a Python source (the rows of the
``ast_facts`` table without its file columns), for use with LATERAL:

    SELECT f.path, a.name, a.line FROM files f, LATERAL ast_facts(f.content) a WHERE a.node = 'FunctionDef'

A source that does not parse gives one ``__error__`` row, a null one ``__undecodable__``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpuslint.operators.extract import FACT_COLUMNS, FACTS_SCHEMA, content_rows

_FILE = ("repo", "path", "size_bytes", "content_hash", "language")
SCHEMA = ", ".join(c for c in FACTS_SCHEMA.split(", ") if c.split()[0] not in _FILE)
_KEPT = [i for i, c in enumerate(FACT_COLUMNS) if c not in _FILE]


class AstFacts:
    def eval(self, content: str) -> Iterator[tuple]:
        raw = content.encode("utf-8") if isinstance(content, str) else None if content is None else bytes(content)
        for row in content_rows("", "", "python", raw, None, None):
            yield tuple(row[i] for i in _KEPT)


def register(spark: SparkSession) -> None:
    """Register ``ast_facts`` in the session's SQL (rows travel in Arrow batches)."""
    spark.udtf.register("ast_facts", udtf(AstFacts, returnType=SCHEMA, useArrow=True))
