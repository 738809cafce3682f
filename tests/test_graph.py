"""SCC cycle detection against a brute-force reference on random small graphs."""

import random

from corpuslint.operators.graph import strongly_connected


def brute_scc(nodes, edges):
    reach = {v: {v} for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    comps = set()
    for v in nodes:
        comp = frozenset(w for w in nodes if w in reach[v] and v in reach[w])
        if len(comp) > 1 or (v, v) in edges:
            comps.add(comp)
    return comps


def test_scc_matches_brute_force(spark):
    rnd = random.Random(7)
    rows_n, rows_e, expected = [], [], set()
    for g in range(12):
        n = rnd.randint(1, 7)
        nodes = [f"n{i}.py" for i in range(n)]
        edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(rnd.randint(0, 2 * n))}
        rows_n += [(f"g{g}", v) for v in nodes]
        rows_e += [(f"g{g}", a, b) for a, b in edges]
        expected |= {(f"g{g}", c) for c in brute_scc(nodes, edges)}
    nd = spark.createDataFrame(rows_n, "repo string, path string")
    ed = spark.createDataFrame(rows_e, "repo string, source string, target string")
    got = {}
    for r in strongly_connected(nd, ed).collect():
        got.setdefault((r.repo, r.comp), set()).add(r.node)
    assert {(repo, frozenset(m)) for (repo, _), m in got.items()} == expected


def test_cycle_evidence_has_only_real_hops(spark):
    from corpuslint.operators.graph import cycle_rows
    rnd = random.Random(11)
    graphs = {"v": {("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "b.py"), ("c.py", "d.py"), ("d.py", "a.py")}}
    for g in range(5):
        nodes = [f"n{i}.py" for i in range(rnd.randint(2, 6))]
        graphs[f"g{g}"] = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(2 * len(nodes))}
    nd = spark.createDataFrame([(g, v) for g, es in graphs.items() for v in {x for e in es for x in e}], "repo string, path string")
    ed = spark.createDataFrame([(g, a, b) for g, es in graphs.items() for a, b in es], "repo string, source string, target string")
    rows = cycle_rows(nd, ed).collect()
    assert len(rows) == sum(len(brute_scc({x for e in es for x in e}, es)) for es in graphs.values())
    for r in rows:
        ring = r.evidence.split(" -> ")
        assert ring[0] == ring[-1] == r.path and len(set(ring)) == len(ring) - 1
        assert all(hop in graphs[r.repo] for hop in zip(ring, ring[1:]))
    assert {r.evidence for r in rows if r.repo == "v"} == {"a.py -> b.py -> c.py -> d.py -> a.py"}


def test_long_rings_and_chains_take_logarithmic_rounds(spark, monkeypatch):
    """Rings of 18 and 200 files differ by a few written tables; chains leading in and out are cut off fast."""
    from corpuslint.operators import graph
    written = []
    write = graph.write_table
    monkeypatch.setattr(graph, "write_table", lambda df: written.append(1) or write(df))
    counts = {}
    for n in (18, 200):
        rnd = random.Random(n)
        names = [f"f{i}.py" for i in range(n)]
        rnd.shuffle(names)
        chain = [f"c{i}.py" for i in range(n)]
        rnd.shuffle(chain)
        edges = list(zip(names, names[1:] + names[:1])) + list(zip(chain, chain[1:])) + [(chain[-1], names[0])]
        nd = spark.createDataFrame([("r", v) for v in names + chain], "repo string, path string")
        ed = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, source string, target string")
        written.clear()
        rows = graph.cycle_rows(nd, ed).collect()
        counts[n] = len(written)
        assert len(rows) == 1 and rows[0].n == n
        ring = rows[0].evidence.split(" -> ")
        assert ring[0] == ring[-1] == min(names) and sorted(ring[1:]) == sorted(names)
        assert all(hop in set(edges) for hop in zip(ring, ring[1:]))
    assert counts[200] - counts[18] <= 20


def test_shortest_cycle_is_the_least_of_the_shortest(spark):
    """Against a plain breadth-first search over whole paths, with branching and chains."""
    from corpuslint.operators.graph import cycle_rows
    rnd = random.Random(23)
    graphs = {}
    for g in range(14):
        nodes = [f"n{i}.py" for i in range(rnd.randint(3, 9))]
        edges = set(zip(nodes, nodes[1:] + nodes[:1])) | {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(rnd.randint(0, 4))}
        mid = [f"m{i}.py" for i in range(4)]
        edges |= set(zip([nodes[0], *mid], [*mid, nodes[2]]))
        graphs[f"g{g}"] = edges
    nd = spark.createDataFrame([(g, v) for g, es in graphs.items() for v in {x for e in es for x in e}], "repo string, path string")
    ed = spark.createDataFrame([(g, a, b) for g, es in graphs.items() for a, b in es], "repo string, source string, target string")
    got = {r.repo: r.evidence.split(" -> ") for r in cycle_rows(nd, ed).collect()}
    for g, edges in graphs.items():
        start = min(x for e in edges for x in e)
        paths = [[start]]
        while not (rings := [p for p in paths if len(p) > 1 and p[-1] == start]):
            paths = [p + [b] for p in paths for a, b in edges if a == p[-1]]
        assert got[g] == min(rings)
