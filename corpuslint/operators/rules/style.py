"""Style rules (H1-H4), Python files only; one explode of the symbol arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.operators.issues import make_issues, seq, union_all
from corpuslint.operators.rules.structure import explode_symbols


def style_issues(t, cfg) -> DataFrame:
    py = t.parsed.filter(F.col("language") == "python")
    fn = explode_symbols(py, "function").withColumn("span", F.col("line_end") - F.col("line_start") + 1)
    cl = explode_symbols(py, "class")
    order = lambda kind, minor: seq("style", 0, F.col("path"), F.col("pos") * 2 + kind, minor)
    return union_all([
        make_issues(fn.filter(~F.col("name").rlike(C.SNAKE_CASE)), "style.function-name", path=F.col("path"),
                    line=F.col("line_start"), evidence=F.array("name"), order=order(0, 0)),
        make_issues(fn.filter(F.col("span") > cfg.style_max_function_lines), "style.function-length",
                    path=F.col("path"), line=F.col("line_start"),
                    evidence=F.array(F.concat(F.lit("function="), "name"), F.concat(F.lit("line_span="), "span")),
                    order=order(0, 1)),
        make_issues(fn.filter(F.col("parameter_count") > cfg.style_max_parameters), "style.too-many-parameters",
                    path=F.col("path"), line=F.col("line_start"),
                    evidence=F.array(F.concat(F.lit("function="), "name"),
                                     F.concat(F.lit("parameter_count="), "parameter_count")),
                    order=order(0, 2)),
        make_issues(cl.filter(~F.col("name").rlike(C.PASCAL_CASE)), "style.class-name", path=F.col("path"),
                    line=F.col("line_start"), evidence=F.array("name"), order=seq("style", 0, F.col("path"), (1 << 40) + F.col("pos"), 0)),
    ])


RULES = [
    (("style.function-name", "style.function-length", "style.too-many-parameters", "style.class-name"), style_issues),
]
