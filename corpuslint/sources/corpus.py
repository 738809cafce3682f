"""Source corpus rendered from the driver `part` table (lane C).

Each `part` row becomes one Python module; every third row also gets a test
file and every tenth a JavaScript file. The text is built with SQL string
expressions on the executors, so the corpus grows with `part` and nothing
passes through the driver. Line positions are fixed (absent features leave a
comment line), which keeps every expected issue computable by arithmetic over
`part` — see ``corpus_oracle_cte`` for the same derivation in DuckDB SQL.

Layout of module ``pkg{k%4}/m{k}.py`` (k = p_partkey, z = p_size, i = k div 25,
p = z % 9, b = z % 12, L = 6 + 2b + z):

  1      import os
  2      from pkg{J%4}.m{J} import f{J}  (i even) | import pkg{J%4}.m{J} (i odd) | comment (no J)
  3      password = 's{k}'               if k % 7 = 0
  4      os                              if z even (marks `os` used)
  5      def f{k}(a0, ..., a{p-1}):
  6..    b times "if 1: / pass", then z times "x = 0"   (function ends at 5+2b+z)
  L,L+1  def Helper{k}(): / pass         if k % 5 = 0
  L+2,3  class item{k}: / pass           if k % 8 = 0
  L+4    one call chosen by k % 11
  L+5    SQL concatenation               if k % 13 in (0, 1)
  L+6..10 loop block                     if k % 6 in (0, 1)

J = k + 25 unless i % 4 = 3, where J = k - 75 when (i div 4) % 3 = 0 (closing a
4-cycle) and no import otherwise. If k % 97 = 0 the module is unparsable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CALLS = [
    "subprocess.run('x', shell=True)",
    "eval('1')",
    "pickle.loads(b)",
    "yaml.load('a')",
    "tempfile.mktemp()",
    "random.randint(1, 2)",
    "yaml.load('a', Loader=yaml.SafeLoader)",
    "f().eval(2)",
    "x.eval(1)",
]


SEEDS_PER_TASK = 10_000


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _module_text_sql() -> str:
    call_case = "CASE k % 11 " + " ".join(f"WHEN {n} THEN {_sql_str(c)}" for n, c in enumerate(_CALLS)) + " ELSE '# no call' END"
    loop0 = "for i in x:\n    for j in y:\n        open(j)\n        len(x)\n        len(y)"
    loop1 = "for i in x:\n    open(i)\n    len(x)\n    len(y)\n# -"
    loopn = "# -\n# -\n# -\n# -\n# -"
    lines = [
        "'import os'",
        "CASE WHEN j IS NULL THEN '# no import' WHEN i % 2 = 0 THEN concat('from pkg', j % 4, '.m', j, ' import f', j) "
        "ELSE concat('import pkg', j % 4, '.m', j) END",
        "CASE WHEN k % 7 = 0 THEN concat('password = ', \"'\", 's', k, \"'\") ELSE '# no secret' END",
        "CASE WHEN z % 2 = 0 THEN 'os' ELSE '# os unused' END",
        "concat('def f', k, '(', CASE WHEN z % 9 = 0 THEN '' ELSE array_join(transform(sequence(0, z % 9 - 1), x -> concat('a', x)), ', ') END, '):')",
        "regexp_replace(concat(repeat('    if 1:\\n        pass\\n', z % 12), repeat('    x = 0\\n', z)), '\\n$', '')",
        "CASE WHEN k % 5 = 0 THEN concat('def Helper', k, '():\\n    pass') ELSE '# no helper\\n# -' END",
        "CASE WHEN k % 8 = 0 THEN concat('class item', k, ':\\n    pass') ELSE '# no class\\n# -' END",
        call_case,
        "CASE k % 13 WHEN 0 THEN \"q = 'SELECT ' + a\" WHEN 1 THEN \"q = 'SELECT ' + a + b\" ELSE '# no sql' END",
        f"CASE k % 6 WHEN 0 THEN {_sql_str(loop0)} WHEN 1 THEN {_sql_str(loop1)} ELSE {_sql_str(loopn)} END",
    ]
    body = "concat_ws('\\n', " + ", ".join(lines) + ")"
    return f"CASE WHEN k % 97 = 0 THEN 'def broken(:\\n' ELSE concat({body}, '\\n') END"


def corpus_files(part: DataFrame) -> DataFrame:
    """`files` table (repo, path, content STRING, size_bytes) rendered from `part`."""
    # The seed rows are tiny and the rendered text ~100x larger: spread the seeds
    # (not the text) so rendering and parsing start out parallel, and over more tasks
    # the more seeds there are, so that what a task parses and caches stays the same.
    tasks = max(8, part.sparkSession.sparkContext.defaultParallelism, part.count() // SEEDS_PER_TASK)
    seeds = part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z")).repartition(tasks, "k")
    base = seeds.selectExpr(
        "k", "z", "k div 25 AS i",
        "CASE WHEN (k div 25) % 4 = 3 THEN CASE WHEN ((k div 25) div 4) % 3 = 0 THEN k - 75 END ELSE k + 25 END AS j",
        "concat('r', k % 25) AS repo",
        "explode(array_compact(array(0, CASE WHEN k % 3 = 0 THEN 1 END, CASE WHEN k % 10 = 1 THEN 2 END))) AS file",
    )
    out = base.selectExpr(
        "repo",
        "CASE file WHEN 0 THEN concat('pkg', k % 4, '/m', k, '.py') WHEN 1 THEN concat('tests/test_m', k, '.py') "
        "ELSE concat('web/app', k, '.js') END AS path",
        f"CASE file WHEN 0 THEN {_module_text_sql()} WHEN 1 THEN concat('def test_m', k, '():\\n    assert True\\n') "
        "ELSE concat('const v', k, ' = 1;\\n') END AS content")
    return out.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


# The same derivation in DuckDB SQL for the oracle side (one row per module).
def corpus_oracle_cte() -> str:
    return """
corpus AS (
  SELECT p_partkey AS k, p_size AS z, p_partkey // 25 AS i,
         CASE WHEN (p_partkey // 25) % 4 = 3 THEN CASE WHEN ((p_partkey // 25) // 4) % 3 = 0 THEN p_partkey - 75 END
              ELSE p_partkey + 25 END AS j,
         'r' || (p_partkey % 25) AS repo,
         'pkg' || (p_partkey % 4) || '/m' || p_partkey || '.py' AS path,
         p_partkey % 97 <> 0 AS ok,
         6 + 2 * (p_size % 12) + p_size AS l0
  FROM part
),
okset AS (SELECT k FROM corpus WHERE ok)"""
