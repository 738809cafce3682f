"""Rule families (O1): which functions make which rules, so that only those asked for are planned.

A family is a list of ``(rule ids, fn(tables, cfg) -> issues)``. ``add_family`` adds one
from outside; its issues then stand with the others in every query and report.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint import config as C
from corpuslint.operators.rules import coverage, performance, security, structure, style

Builder = Callable[..., DataFrame]

FAMILIES: dict[str, list[tuple[tuple[str, ...], Builder]]] = {
    "structure": structure.RULES, "security": security.RULES, "style": style.RULES,
    "performance": performance.RULES, "test": coverage.RULES,
}


def add_family(name: str, catalogue: dict[str, tuple[str, str, str, float]], rules: list[tuple[tuple[str, ...], Builder]],
               severity: str = "low") -> None:
    """Add a family: its rules' catalogue (id: title, description, severity, confidence), builders and roll-up severity."""
    wrong = [r for r in catalogue if not r.startswith(f"{name}.")] + [r for ids, _ in rules for r in ids if r not in catalogue]
    if name in FAMILIES or wrong:
        raise ValueError(f"family {name!r} exists or has rules outside its catalogue: {wrong}")
    C.RULES.update(catalogue)
    C.FAMILY_RANK[name] = max(C.FAMILY_RANK.values()) + 1
    C.FAMILY_ISSUE_SEVERITY[name] = severity
    FAMILIES[name] = rules


def remove_family(name: str) -> None:
    """Take an added family out again."""
    if name in C.FULL_FAMILIES:
        raise ValueError(f"{name!r} is built in")
    del FAMILIES[name], C.FAMILY_RANK[name], C.FAMILY_ISSUE_SEVERITY[name]
    for rule in [r for r in C.RULES if r.startswith(f"{name}.")]:
        del C.RULES[rule]


def active_families(cfg: C.Settings) -> tuple[str, ...]:
    """The settings' families; when they name none, the added ones too."""
    added = tuple(f for f in FAMILIES if f not in C.FULL_FAMILIES) if cfg.families is None else ()
    return cfg.active_families + added


def select_rules(severities: Iterable[str] | None = None, families: Iterable[str] | None = None) -> set[str] | None:
    """The rule ids of the given severities and families; None stands for all."""
    if not severities and not families:
        return None
    return {r for r, (_, _, sev, _) in C.RULES.items()
            if (not severities or sev in severities) and (not families or r.split(".", 1)[0] in families)}


def built(t, cfg: C.Settings, rules: Iterable[str] | None = None) -> list[DataFrame]:
    """The issue tables of the active families, of the given rules only; no other rule is planned."""
    wanted = None if rules is None else set(rules)
    out = []
    for family in active_families(cfg):
        for ids, build in FAMILIES[family]:
            if wanted is None or wanted.issuperset(ids):
                out.append(build(t, cfg))
            elif wanted & set(ids):
                out.append(build(t, cfg).filter(F.col("rule_id").isin(sorted(wanted))))
    return out
