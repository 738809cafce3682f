"""Import graph (C1-C4) and cycle detection (F1).

Resolution is a left outer equi-join of exploded imports to a module index.

Cycles are strongly connected components (no graph is ever collected). A round gives each
node the least label that reaches it (f) and the least label that it reaches (g), in an
order of the nodes that is hashed anew each round. Where f = g, the nodes of that label
are one component. An edge whose ends differ in f or in g lies in none and goes; with an
order at random that cuts what is left about in half. Labels travel along edges, through
the labels' own labels, and along one pointer a node, which is doubled each step, so a
path of n nodes takes about log n steps. The shortest cycle of a component is searched over its branching nodes only:
chains of nodes with one way in and one way out are first contracted by doubling.

Each step is one written table; lineage is cut and nothing is recomputed when an executor
is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.functions.columns import path_key
from corpuslint.session import cut_lineage, delete_tables, write_table


def module_index(parsed: DataFrame) -> DataFrame:
    """Dotted module -> path for Python files; `__init__.py` also names its package.

    On a collision the last file in path order wins.
    """
    py = parsed.filter(F.col("language") == "python").select("repo", "path")
    module = F.regexp_replace(F.regexp_replace("path", "\\.[^./]*$", ""), "/", ".")
    package = F.when(F.col("path").endswith("/__init__.py"),
                     F.regexp_replace(F.regexp_replace("path", "/__init__\\.py$", ""), "/", "."))
    entries = py.select("repo", "path", F.explode(F.array_compact(F.array(module, package))).alias("module"))
    return entries.groupBy("repo", "module").agg(F.max_by("path", path_key("path")).alias("target_path"))


def build_edges(parsed: DataFrame) -> DataFrame:
    """Edges (repo, source, target, edge_type, resolution_confidence, resolved, source_key, module)."""
    imports = parsed.select("repo", F.col("path").alias("source"), F.explode("imports").alias("module"))
    idx = module_index(parsed)
    joined = imports.join(_spread(idx), ["repo", "module"], "left")
    resolved = F.col("target_path").isNotNull()
    return joined.select(
        "repo", "source",
        F.coalesce("target_path", "module").alias("target"),
        F.lit("import").alias("edge_type"),
        F.when(resolved, 1.0).otherwise(0.3).alias("resolution_confidence"),
        resolved.alias("resolved"),
        "module",
    )


def dependencies_by_source(edges: DataFrame) -> DataFrame:
    """C4: per-file adjacency, targets sorted, duplicates kept."""
    return edges.groupBy("repo", F.col("source").alias("path")).agg(
        F.array_sort(F.collect_list("target")).alias("dependencies"))


def _spread(df: DataFrame) -> DataFrame:
    """A side of a join that never goes through the driver: a search joins tables of a few MB dozens of times."""
    return df.hint("merge")


def file_edges(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is itself a parsed file (the graph cycles are searched in)."""
    nodes = parsed.select("repo", F.col("path").alias("target"))
    return edges.join(_spread(nodes), ["repo", "target"], "left_semi").select("repo", "source", "target")


class _Rounds:
    """Tables of an iterative graph job, each written once under the shared checkpoint folder and read back.

    `release` deletes them once the job's result is written. (Persisting instead leaves a
    growing set of cache entries that every later query is matched against.)
    """

    def __init__(self, spark):
        self.spark = spark
        self.paths: list[str] = []

    def settle(self, df: DataFrame) -> DataFrame:
        df, path = write_table(df)
        self.paths.append(path)
        return df

    def release(self) -> None:
        delete_tables(self.spark, self.paths)
        self.paths = []


def _labels(r: _Rounds, edges: DataFrame, turn: int) -> DataFrame:
    """(repo, node, f, g) for the ends of the edges (repo, src, dst), in the order of this turn.

    `back` points to one of the nodes that reach the node, `ahead` to one that it reaches;
    after k steps they stand 2 ** k hops off, and f and g cover all nodes between.
    """
    def label(c: str):
        return F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))

    def heard(df: DataFrame, node: str = "node", **given) -> DataFrame:
        kinds = {c: "string" if c in ("back", "ahead") else "struct<h:bigint,v:string>" for c in ("f", "g", "f0", "g0", "back", "ahead")}
        return df.select("repo", F.col(node).alias("node"), *[given.get(c, F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])

    ends = edges.groupBy("repo", F.col("dst").alias("node")).agg(F.min(label("src")).alias("least"))
    into = heard(ends, back=F.col("least.v"))
    ends = edges.groupBy("repo", F.col("src").alias("node")).agg(F.min(label("dst")).alias("least"))
    first = into.unionByName(heard(ends, ahead=F.col("least.v"))).groupBy("repo", "node").agg(F.max("back").alias("back"), F.max("ahead").alias("ahead"))
    labels = r.settle(first.select("repo", "node", label("node").alias("f"), label("node").alias("g"), "back", "ahead", F.lit(True).alias("changed")))
    while True:
        told = heard(labels, f=F.col("f"), g=F.col("g"), f0=F.col("f"), g0=F.col("g"))
        of_src = labels.select("repo", F.col("node").alias("src"), "f")
        of_dst = labels.select("repo", F.col("node").alias("dst"), "g")
        told = told.unionByName(heard(edges.join(_spread(of_src), ["repo", "src"]), "dst", f=F.col("f")))
        told = told.unionByName(heard(edges.join(_spread(of_dst), ["repo", "dst"]), "src", g=F.col("g")))
        for way, own in (("back", "f"), ("ahead", "g")):
            asked = labels.select("repo", "node", F.explode(F.array(F.struct(F.lit(True).alias("far"), F.col(way).alias("at")),
                                                                     F.struct(F.lit(False).alias("far"), F.col(f"{own}.v").alias("at")))).alias("q"))
            there = labels.select("repo", F.col("node").alias("at"), own, F.col(way).alias("next"))
            answers = asked.select("repo", "node", "q.far", "q.at").join(_spread(there), ["repo", "at"])
            told = told.unionByName(heard(answers, **{own: F.col(own), way: F.when(F.col("far"), F.col("next"))}))
        merged = told.groupBy("repo", "node").agg(*[F.min(c).alias(c) for c in ("f", "g", "f0", "g0", "back", "ahead")])
        changed = (F.col("f") != F.col("f0")) | (F.col("g") != F.col("g0"))
        labels = r.settle(merged.select("repo", "node", "f", "g", "back", "ahead", changed.alias("changed")))
        if labels.filter("changed").isEmpty():
            return labels


def _peeled(r: _Rounds, edges: DataFrame) -> DataFrame:
    """The edges without whole chains that come from nowhere or lead nowhere, found by doubling.

    A node without an edge into it is in no cycle, nor is one whose only edge into it comes
    from such a node, and so on; likewise outwards. A step doubles each chain node's pointer;
    one that finds no further such node is the last.
    """
    into = edges.groupBy("repo", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.first("src").alias("src"))
    out = edges.groupBy("repo", F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.first("dst").alias("dst"))
    state = r.settle(into.join(_spread(out), ["repo", "node"], "full").select(
        "repo", "node", F.when(F.col("n_in") == 1, F.col("src")).alias("back"), F.when(F.col("n_out") == 1, F.col("dst")).alias("ahead"),
        F.col("n_in").isNull().alias("first"), F.col("n_out").isNull().alias("last"), F.lit(False).alias("found")))
    if state.filter("first or last").isEmpty():
        return edges
    while True:
        before = state.select("repo", F.col("node").alias("back"), F.col("back").alias("back2"), F.col("first").alias("first2"))
        behind = state.select("repo", F.col("node").alias("ahead"), F.col("ahead").alias("ahead2"), F.col("last").alias("last2"))
        joined = state.join(_spread(before), ["repo", "back"], "left").join(_spread(behind), ["repo", "ahead"], "left")
        first, last = (F.col(c) | F.coalesce(f"{c}2", F.lit(False)) for c in ("first", "last"))
        state = r.settle(joined.select("repo", "node", F.col("back2").alias("back"), F.col("ahead2").alias("ahead"), first.alias("first"), last.alias("last"),
                                       ((first & ~F.col("first")) | (last & ~F.col("last"))).alias("found")))
        if state.filter("found").isEmpty():
            break
    alive = state.filter("not first and not last").select("repo", "node")
    return (edges.join(_spread(alive.withColumnRenamed("node", "src")), ["repo", "src"], "left_semi")
            .join(_spread(alive.withColumnRenamed("node", "dst")), ["repo", "dst"], "left_semi").select("repo", "src", "dst"))


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, node, comp) for every node in a non-trivial SCC (size > 1 or a self-loop)."""
    spark = nodes.sparkSession
    r = _Rounds(spark)
    known = nodes.select("repo", "path")
    all_edges = r.settle(edges.select("repo", F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
                         .join(_spread(known.withColumnRenamed("path", "src")), ["repo", "src"], "left_semi")
                         .join(_spread(known.withColumnRenamed("path", "dst")), ["repo", "dst"], "left_semi"))

    live, found, turn = all_edges.filter("src <> dst"), [], 0
    if not live.isEmpty():
        live = r.settle(_peeled(r, live))
    while not live.isEmpty():
        labels = _labels(r, live, turn)
        found.append(labels.filter("f = g").select("repo", "node", F.col("f.v").alias("comp")))
        left, right = (labels.filter("f <> g").select("repo", F.col("node").alias(end), F.col("f").alias(f"f_{end}"), F.col("g").alias(f"g_{end}"))
                       for end in ("src", "dst"))
        same = live.join(_spread(left), ["repo", "src"]).join(_spread(right), ["repo", "dst"]).filter("f_src = f_dst and g_src = g_dst")
        live = r.settle(same.select("repo", "src", "dst"))
        if not live.isEmpty():
            live = r.settle(_peeled(r, live))
        turn += 1
    loops = all_edges.filter("src = dst").select("repo", F.col("src").alias("node"), F.col("src").alias("comp"))
    if found:
        members = union_frames(found)
        several = members.groupBy("repo", "comp").agg(F.count("*").alias("n")).filter("n > 1").select("repo", "comp")
        members = members.join(_spread(several), ["repo", "comp"], "left_semi").select("repo", "node", "comp")
        loops = members.unionByName(loops.join(_spread(members.select("repo", "node")), ["repo", "node"], "left_anti"))
    out = cut_lineage(loops)
    r.release()
    return out


def cycle_rows(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per cycle component: repo, path (first member in file order), evidence, n (members).

    The evidence is a shortest cycle through that member, ``a -> b -> a``; every
    printed hop is an import. Of several shortest ones the string-smallest is named.
    """
    fe = file_edges(parsed, edges)
    comps = strongly_connected(parsed.select("repo", "path"), fe)
    if comps.isEmpty():
        return parsed.sparkSession.createDataFrame([], "repo string, path string, evidence string, n bigint")
    members = comps.select("repo", F.col("node").alias("path"), "comp")
    start = members.groupBy("repo", "comp").agg(F.min_by("path", path_key("path")).alias("start"),
                                                F.count("*").alias("n"))
    inner = (fe.distinct()
               .join(_spread(members.withColumnRenamed("path", "source")), ["repo", "source"])
               .join(_spread(members.withColumnRenamed("path", "target").withColumnRenamed("comp", "comp_t")), ["repo", "target"])
               .filter(F.col("comp") == F.col("comp_t"))
               .select("repo", "comp", "source", "target"))
    return (start.join(_spread(shortest_cycles(inner, start)), ["repo", "comp"])
            .select("repo", F.col("start").alias("path"), F.array_join("ring", " -> ").alias("evidence"), "n"))


def _chains(r: _Rounds, inner: DataFrame, start: DataFrame) -> DataFrame:
    """(repo, comp, node, nxt, hops, last): each node with one way in and one way out (the start is none).

    `nxt` is the branching node that its chain ends in, `hops` edges on, and `last` the
    chain's last node. Doubling: a node takes over what the node it points to knows.
    """
    key = ["repo", "comp"]
    out = inner.groupBy(*key, F.col("source").alias("node")).agg(F.count("*").alias("n_out"), F.first("target").alias("nxt")).filter("n_out = 1")
    into = inner.groupBy(*key, F.col("target").alias("node")).agg(F.count("*").alias("n_in")).filter("n_in = 1")
    through = (out.join(_spread(into), [*key, "node"]).join(_spread(start.select(*key, F.col("start").alias("node"))), [*key, "node"], "left_anti")
               .select(*key, "node", "nxt", F.lit(1).alias("hops"), F.col("node").alias("last")))
    chains = r.settle(through)
    while True:
        ahead = chains.select(*key, F.col("node").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("hops").alias("hops2"), F.col("last").alias("last2"))
        nxt = r.settle(chains.join(_spread(ahead), [*key, "nxt"], "left").select(
            *key, "node", F.coalesce("nxt2", "nxt").alias("nxt"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"),
            F.coalesce("last2", "last").alias("last"), F.col("nxt2").isNotNull().alias("moved")))
        chains = nxt.drop("moved")
        if nxt.filter("moved").isEmpty():
            return chains


def shortest_cycles(inner: DataFrame, start: DataFrame) -> DataFrame:
    """(repo, comp, ring): a shortest cycle from each component's start back to it.

    Over the branching nodes and the contracted chains between them, all components
    together: a round extends every prefix that became shorter (or, at equal length,
    string-smaller) in the round before; a prefix is the first node of each of its hops,
    which fixes it and orders prefixes as the nodes on the way do.
    """
    r = _Rounds(inner.sparkSession)
    key = ["repo", "comp"]
    inner, start = r.settle(inner), r.settle(start.select(*key, "start"))
    chains = _chains(r, inner, start)
    through = chains.select(*key, F.col("node").alias("first"), F.col("nxt").alias("to"), F.col("hops"))
    hop = (inner.join(_spread(chains.select(*key, F.col("node").alias("source"))), [*key, "source"], "left_anti")
           .select(*key, F.col("source").alias("node"), F.col("target").alias("first"))
           .join(_spread(through), [*key, "first"], "left")
           .select(*key, "node", "first", F.coalesce("to", "first").alias("to"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops")))
    hop = r.settle(hop)
    nothing = F.struct(F.lit(0).alias("length"), F.expr("cast(array() as array<string>)").alias("firsts"))
    best = r.settle(start.select(*key, "start", F.col("start").alias("node"), F.lit(False).alias("closed"), nothing.alias("way"), F.lit(True).alias("fresh")))
    while True:
        closed = best.filter("closed").select(*key, F.col("way.length").alias("shortest"))
        longer = F.struct((F.col("way.length") + F.col("hops")).alias("length"), F.concat("way.firsts", F.array("first")).alias("firsts"))
        ways = (best.filter("fresh and not closed").join(_spread(hop), [*key, "node"]).join(_spread(closed), key, "left")
                .filter("shortest is null or way.length + hops <= shortest")
                .select(*key, "start", F.col("to").alias("node"), (F.col("to") == F.col("start")).alias("closed"), longer.alias("way"), F.lit(None).cast(best.schema["way"].dataType).alias("was")))
        merged = (best.select(*key, "start", "node", "closed", "way", F.col("way").alias("was")).unionByName(ways)
                  .groupBy(*key, "start", "node", "closed").agg(F.min("way").alias("way"), F.min("was").alias("was")))
        best = r.settle(merged.select(*key, "start", "node", "closed", "way", (F.col("was").isNull() | (F.col("way") < F.col("was"))).alias("fresh")))
        if best.filter("fresh and not closed").isEmpty():
            break
    rings = best.filter("closed").select(*key, "start", F.posexplode("way.firsts").alias("at", "first"))
    ends = rings.join(_spread(through), [*key, "first"], "left").select(*key, "start", "at", F.lit(0).alias("before"), F.coalesce("to", "first").alias("node"))
    on_way = (rings.join(_spread(chains.select(*key, F.col("node").alias("first"), "last")), [*key, "first"])
              .join(_spread(chains.select(*key, "last", "node", "hops")), [*key, "last"])
              .select(*key, "start", "at", (-F.col("hops")).alias("before"), "node"))
    listed = ends.unionByName(on_way).groupBy(*key, "start").agg(F.array_sort(F.collect_list(F.struct("at", "before", "node"))).alias("steps"))
    ring = F.concat(F.array("start"), F.transform("steps", lambda x: x["node"]))
    out = cut_lineage(listed.select(*key, ring.alias("ring")))
    r.release()
    return out


def union_frames(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
