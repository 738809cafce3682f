"""The whole review as one plan over many repositories.

``analyze(files, history, cfg)`` builds DataFrames; what starts jobs while plans are
built is a count or byte budget (its phases) and, when an issue table with
``structure.circular-dependency`` is asked for, the cycle search. Rules are chosen
before anything is planned: ``raw_issues(rules)``, ``issues(rules)`` and ``query(opts)``
plan the rules asked for and no others. ``write_issues()`` writes the issues of every rule,
builder by builder, for callers that go on with all of them. Content crosses into Python
once (the parse stage), the facts it yields are shared by every rule branch, and everything
after is joins, aggregates and ranking windows keyed by ``repo``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.config import Settings
from corpuslint.operators import context as ctx
from corpuslint.operators import extract, scan
from corpuslint.operators.graph import build_edges, dependencies_by_source
from corpuslint.operators import report as rep
from corpuslint.operators.issues import as_issues, empty_issues, union_all
from corpuslint.operators.rules import registry
from corpuslint.session import delete_tables, share, write_table


@dataclass
class Tables:
    cfg: Settings
    decisions: DataFrame
    repos: DataFrame
    facts: DataFrame
    parsed: DataFrame
    failed: DataFrame
    edges: DataFrame
    file_contexts: DataFrame
    highlighted: DataFrame
    key_files: DataFrame
    focus: DataFrame
    budget: DataFrame
    changes: DataFrame
    targets: DataFrame
    history: DataFrame | None
    extra: dict = field(default_factory=dict)

    # Issue tables are built on first use so callers that only need the context pay nothing.
    def raw_issues(self, rules: Iterable[str] | None = None) -> DataFrame:
        """Issues of the active families, of the given rules only if some are given."""
        key = ("raw_issues", None if rules is None else frozenset(rules))
        if key not in self.extra:
            found = registry.built(self, self.cfg, rules)
            self.extra[key] = union_all(found) if found else empty_issues(self.facts.sparkSession)
        return self.extra[key]

    def write_issues(self) -> DataFrame:
        """`raw_issues()` once written, one job for each builder of rules; later calls of it read the tables.

        One plan over all rules has thousands of nodes, planned anew after each of its stages, and
        each task brings the metrics of every rule back to the driver; a builder's plan has some hundred.
        The tables stay for what reads them until `drop_written`.
        """
        if "written" not in self.extra:
            spark, t, aside = self.facts.sparkSession, self, []
            if "performance" in self.cfg.active_families:  # the budget reads the key files twice
                highlighted, keys = self.extra["ranked"]
                keys, path = write_table(keys)
                aside.append(path)
                focus = ctx.focus_paths(self.edges, keys, self.cfg.dependency_edge_cap)
                t = replace(self, budget=ctx.budget(self.repos, self.parsed, highlighted, keys, focus, self.cfg))
            self.extra["written"] = paths = [write_table(as_issues(df))[1] for df in registry.built(t, self.cfg)]
            delete_tables(spark, aside)
            none = empty_issues(spark)
            self.extra["raw_issues", None] = spark.read.schema(none.schema).parquet(*paths) if paths else none
        return self.extra["raw_issues", None]

    def drop_written(self) -> None:
        """Delete the tables of `write_issues` once nothing reads them any more."""
        delete_tables(self.facts.sparkSession, self.extra.pop("written", []))
        self.extra.pop(("raw_issues", None), None)

    def issues(self, rules: Iterable[str] | None = None) -> DataFrame:
        return ctx.new_issues(self.raw_issues(rules), self.history, self.cfg)

    def query(self, opts: rep.QueryOptions) -> DataFrame:
        """L1-L8 over the new issues; severities and families that are filtered out are never planned."""
        return rep.query_issues(self.issues(registry.select_rules(opts.severity_filter, opts.agent_filter)), opts)

    def contexts_with_issues(self) -> DataFrame:
        """K2: file contexts with their new issues; in summary mode with suggestions only."""
        return ctx.with_issues(self.file_contexts, self.issues(), include_issue_lists=not self.cfg.summary_only)

    def next_history(self) -> DataFrame:
        return ctx.next_history(self.parsed, self.issues(), self.history, self.cfg)

    def release(self) -> None:
        """Drop the shared (persisted) tables of this run once its results are written."""
        for df in self.extra.pop("persisted", []):
            df.unpersist()


def analyze(files: DataFrame, history: DataFrame | None = None, cfg: Settings | None = None,
            persist_facts: bool = True) -> Tables:
    cfg = cfg or Settings()
    decisions = scan.admit(files, cfg)
    repos = files.select("repo").distinct()
    accepted = scan.accepted_files(files, decisions, cfg)
    facts = extract.extract_facts(accepted, cfg.parse_partitions)
    persisted = []
    if persist_facts:
        # One parse per file, read by every rule branch: sorted by node, a cached batch holds one
        # or two kinds, and a branch reads only the batches whose least and largest node admit its kinds.
        facts = share(facts.sortWithinPartitions("node"))
        persisted.append(facts)
    parsed = extract.parsed_files(facts)
    if persist_facts:
        parsed = share(parsed)  # the hub table: graph, context and every family read it
        persisted.append(parsed)
    failed = union_all([scan.skipped_files(decisions).drop("skip_rule"), extract.parse_failures(facts)])
    edges = build_edges(parsed)
    if persist_facts:
        edges = share(edges)
        persisted.append(edges)
    file_contexts = parsed.join(dependencies_by_source(edges), ["repo", "path"], "left").withColumn(
        "dependencies", F.coalesce("dependencies", F.expr("cast(array() as array<string>)")))
    highlighted = ctx.first_paths(parsed.select("repo", "path"), cfg.structure_summary_max_paths)
    keys = ctx.key_files(parsed, edges, cfg.key_files_cap)
    focus = ctx.focus_paths(edges, keys, cfg.dependency_edge_cap)
    ranked = (highlighted, keys)
    bud = ctx.budget(repos, parsed, highlighted, keys, focus, cfg)
    changes = ctx.file_changes(parsed, history)
    targets = ctx.target_files(changes, cfg)
    if cfg.summary_only:  # D9: pruned after the budget used them
        highlighted = highlighted.limit(0)
        keys = keys.limit(0)
        focus = focus.limit(0)
    return Tables(cfg=cfg, decisions=decisions, repos=repos, facts=facts, parsed=parsed,
                  failed=failed, edges=edges, file_contexts=file_contexts, highlighted=highlighted,
                  key_files=keys, focus=focus, budget=bud, changes=changes, targets=targets, history=history,
                  extra={"persisted": persisted, "ranked": ranked})
