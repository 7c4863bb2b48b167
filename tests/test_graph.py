import random
from collections import defaultdict, deque

from helpers import ids

from codegrove.operators import components as C
from codegrove.operators import graph_lookup as L
from codegrove.operators import metrics as M
from codegrove.operators import modularity as Q
from codegrove.operators import traversal as V
from codegrove.sources import tables as D


def mirrored(pairs, kind="calls", inverse="called_by"):
    return [(a, b, kind) for a, b in pairs] + [(b, a, inverse) for a, b in pairs]


def test_call_chain(make_graph):
    n, e = make_graph(dict.fromkeys("abc", "function"), mirrored([("a", "b"), ("b", "c")]))
    assert ids(V.callers(n, e, "c")) == {"a", "b"}
    assert ids(V.callees(n, e, "a")) == {"b", "c"}
    assert ids(V.callees(n, e, "a", 1)) == {"b"}
    assert ids(M.dead_code(n, e)) == {"a"}


def test_inheritance_chain(make_graph):
    n, e = make_graph(dict.fromkeys("ABC", "class"), mirrored([("B", "A"), ("C", "B")], "inherits", "inherited_by"))
    assert ids(V.ancestors(n, e, "C")) == {"A", "B"}
    assert ids(V.descendants(n, e, "A")) == {"B", "C"}


def test_diamond_paths(make_graph):
    n, e = make_graph(dict.fromkeys("abcd", "function"), [(a, b, "calls") for a, b in ("ab", "bd", "ac", "cd")])
    best = V.shortest_path(e, "a", "d").collect()
    assert [list(r.path) for r in best] == [["a", "b", "d"]] and best[0].total_weight == 2.0
    assert V.shortest_path(e, "d", "a").count() == 0
    assert V.all_paths(e, "a", "d").count() == 2
    assert V.all_paths(e, "a", "d", 3).count() == 2
    assert V.all_paths(e, "a", "d", 2).count() == 0


def test_ego_graph(make_graph):
    n, e = make_graph({f"node{i}": "function" for i in range(5)}, [
        ("node0", "node1", "calls"), ("node1", "node2", "calls"), ("node0", "node3", "calls"), ("node3", "node4", "calls")])
    near, inside = V.ego_graph(n, e, "node0", 1)
    assert ids(near) == {"node0", "node1", "node3"} and inside.count() == 2


def test_traverse_options(make_graph):
    n, e = make_graph({"a": "function", "b": "class", "c": "function"}, [("a", "b", "calls"), ("b", "c", "imports")])
    o = V.TraversalOptions
    assert ids(V.traverse(n, e, "a", o(node_types=["function"]))) == {"c"}
    assert ids(V.traverse(n, e, "a", o(edge_types=["calls"], include_self=True))) == {"a", "b"}
    assert ids(V.traverse(n, e, "c", o(direction="incoming"))) == {"a", "b"}
    assert ids(V.traverse(n, e, "b", o(direction="both", max_depth=1))) == {"a", "c"}


def test_large_digraph(make_graph):
    """The 1,000-node fixture: out-degree and in-degree five, no self loops."""
    edges = [(f"n{i}", f"n{(i + 100 * j + 1) % 1000}", "calls" if j % 2 == 0 else "imports") for i in range(1000) for j in range(5)]
    n, e = make_graph({f"n{i}": "function" if i % 3 == 0 else "class" for i in range(1000)}, edges)
    stats = M.graph_stats(n, e).first()
    assert (stats.node_count, stats.edge_count, stats.connected_components) == (1000, 5000, 1)
    assert {r.score for r in M.degrees(n, e).collect()} == {10.0}
    assert M.hubs(n, e, 10).count() == 1000 and M.isolated(n, e).count() == 0
    assert ids(V.dependencies(n, e, "n0")) == {"n1", "n101", "n201", "n301", "n401"}


def random_digraph(seed, n, m):
    rnd = random.Random(seed)
    return [f"v{i:02d}" for i in range(n)], sorted({(f"v{rnd.randrange(n):02d}", f"v{rnd.randrange(n):02d}") for _ in range(m)})


def reachable(start, adj):
    seen, todo = {start}, [start]
    while todo:
        for w in adj[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def test_components_by_brute_force(make_graph):
    names, pairs = random_digraph(3, 40, 45)
    out, both = defaultdict(set), defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
        both[a].add(b)
        both[b].add(a)
    n, e = make_graph(dict.fromkeys(names, "function"), [(a, b, "calls") for a, b in pairs])
    weak = {r.id: r.component for r in C.weak_components(n, e).collect()}
    assert weak == {v: min(reachable(v, both)) for v in names}
    strong = {r.id: r.component for r in C.strong_components(n, e).collect()}
    closure = {v: reachable(v, out) for v in names}
    assert strong == {v: min(w for w in closure[v] if v in closure[w]) for v in names}
    assert C.cycles(n, e).count() == sum(1 for v in names if any(v in closure[w] for w in closure[v] if w != v))


def test_hub_component(make_graph):
    """A third of all edges at one node."""
    edges = [("hub", f"x{i}", "calls") for i in range(300)] + [(f"y{i}", f"y{i + 1}", "calls") for i in range(60)]
    names = {a for a, _, _ in edges} | {b for _, b, _ in edges}
    n, e = make_graph(dict.fromkeys(names, "function"), edges)
    sizes = sorted(r.size for r in C.component_sizes(C.weak_components(n, e)).collect())
    assert sizes == [61, 301]


def test_weak_components_stage_little(make_graph, monkeypatch):
    """Rounds shrink: a chain, a hub and pairs are settled with few rows written. Null ends, loops and unknown ends."""
    rnd = random.Random(1)
    chain = rnd.sample(range(3000), 3000)
    pairs = [(f"c{a}", f"c{b}") for a, b in zip(chain, chain[1:])]
    pairs += [("h", f"x{i}") for i in range(3000)] + [(f"p{i}", f"q{i}") for i in range(3000)]
    names = sorted({x for p in pairs for x in p})
    n, e = make_graph(dict.fromkeys([*names, "alone"], "function"), [(a, b, "calls") for a, b in [*pairs, ("alone", "alone"), ("p0", None), ("p1", "a")]])
    staged, put = [], C.Stage.put

    def counted(self, df, **measures):
        table, seen = put(self, df, **measures)
        staged.append(seen["rows"])
        return table, seen

    monkeypatch.setattr(C.Stage, "put", counted)
    got = {r.id: r.component for r in C.weak_components(n, e).collect()}
    want = {x: "c0" if x[0] == "c" else "h" if x[0] in "hx" else "p" + x[1:] for x in names} | {"alone": "alone", "p1": "a", "q1": "a"}
    assert got == want
    assert sum(staged) < 8 * len(pairs)


def test_known_ids_and_pairs(spark):
    """One aggregate and no join; repeated keys are one row, keys with a null are not known."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", None), (None, None)], "src string, dst string")
    asked = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", None), (None, None), ("c", "b")], "src string, dst string")
    found = L.known_edges(edges, asked)
    assert {(r.src, r.dst): r.known for r in found.collect()} == {
        ("a", "b"): True, ("b", "a"): False, ("a", None): False, (None, None): False, ("c", "b"): False}
    assert found.count() == 5
    nodes = edges.selectExpr("src AS id")
    known = L.known_nodes(nodes, asked.selectExpr("dst AS id"))
    assert {r.id: r.known for r in known.collect()} == {"a": True, "b": True, None: False} and known.count() == 3
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_betweenness_by_brute_force(make_graph):
    names, pairs = random_digraph(5, 14, 40)
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
    want = dict.fromkeys(names, 0.0)
    for s in names:
        dist, sigma, order, preds = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    n, e = make_graph(dict.fromkeys(names, "function"), [(a, b, "calls") for a, b in pairs])
    got = {r.id: r.score for r in M.centrality(n, e).collect()}
    scale = (len(names) - 1) * (len(names) - 2)
    assert all(abs(got[v] - want[v] / scale) < 1e-9 for v in names)


def test_positions(spark, make_graph):
    spans = [("c", 1, 100), ("m1", 3, 9), ("m2", 10, 40), ("inner", 12, 13), ("one", 50, 50)]
    n = spark.createDataFrame([("f.py", i, a, b) for i, a, b in spans], "file_path string, id string, line_start int, line_end int")
    pos = spark.createDataFrame([("f.py", i) for i in range(0, 105)], "file_path string, line int")
    got = {r.line: r.id for r in L.at_position(n, pos, innermost=True).collect()}
    want = {}
    for line in range(0, 105):
        hits = sorted((b - a, a, i) for i, a, b in spans if a <= line <= b)
        if hits:
            want[line] = hits[0][2]
    assert got == want
    assert {r.id for r in L.at_position(n, pos).collect()} == {"c"}


def test_impact_paths(make_graph):
    n, e = make_graph(dict.fromkeys("abc", "function"), mirrored([("a", "b"), ("b", "c")]))
    rows = V.impact_paths(n, e, "c", 3).collect()
    assert {tuple(r.path) for r in rows} == {("c", "b"), ("c", "b", "a")}
    assert V.impact_score(V.dependents(n, e, "c", 3), n).first()[0] == 1.0


def counted_stages(monkeypatch):
    """Rows of every table that is staged from here on."""
    staged, put = [], C.Stage.put

    def counted(self, df, **measures):
        table, seen = put(self, df, **measures)
        staged.append(seen["rows"])
        return table, seen

    monkeypatch.setattr(C.Stage, "put", counted)
    return staged


def test_impact_paths_stage_the_edges_once(make_graph, monkeypatch):
    # a small affected part beside a large graph, with parallel edges of other weights
    far = [(f"x{i}", f"y{i % 40}") for i in range(800)]
    near = [("a", "b"), ("b", "c"), ("d", "b"), ("a", "c")]
    n, e = make_graph(dict.fromkeys([*"abcd", *{i for p in far for i in p}], "function"), mirrored([*far, *near]))
    extra = e.filter("src = 'c' and dst = 'b'").selectExpr("src", "dst", "'uses' as edge_type", "0.5D as weight", "metadata")
    edges = e.unionByName(extra)
    staged = counted_stages(monkeypatch)
    got = {(tuple(r.path), r.hops, r.total_weight) for r in V.impact_paths(n, edges, "c", 3).collect()}
    assert got == {(("c", "b"), 1, 0.5), (("c", "a"), 1, 1.0), (("c", "b", "a"), 2, 1.5), (("c", "b", "d"), 2, 1.5), (("c", "a", "b"), 2, 2.0)}
    assert sum(staged) < 1.2 * (2 * len(far + near) + 1)


def test_modularity_stages_no_edges(make_graph, monkeypatch):
    pairs = [(f"n{a}", f"n{b}") for a in range(12) for b in range(12)]
    n, e = make_graph(dict.fromkeys((f"n{i}" for i in range(10)), "function"), [(a, b, "calls") for a, b in pairs])
    kinds = n.selectExpr("id", "int(substr(id, 2)) % 3 as community")
    staged = counted_stages(monkeypatch)
    row = Q.modularity(kinds, e).first()
    # n10 and n11 are no members, but communities of their own
    home = {f"n{i}": i % 3 if i < 10 else f"n{i}" for i in range(12)}
    total, inside = defaultdict(float), 0.0
    for a, b in pairs:
        total[home[a]] += 1
        total[home[b]] += 1
        inside += 2 * (home[a] == home[b])
    m2 = sum(total.values())
    assert row.communities == 3 and abs(row.modularity - (inside / m2 - sum((t / m2) ** 2 for t in total.values()))) < 1e-12
    assert sum(staged) <= 10


def test_calls_are_made_distinct_as_numbers(spark, tmp_path):
    rows = [(1, 5, 7), (1, 5, 7), (1, 6, 7), (2, 5, 8), (None, 5, 7), (3, None, 9), (3, None, 9)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = D.call_pairs(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
        ("order:1", "part:5"), ("order:1", "part:6"), ("order:2", "part:5"), (None, "part:5"), ("order:3", None),
        ("part:5", "supplier:7"), ("part:6", "supplier:7"), ("part:5", "supplier:8"), (None, "supplier:9"),
    ]))
    assert "hashpartitioning(l_orderkey" in found._jdf.queryExecution().executedPlan().toString()
