"""Graph queries: lookups, traversal, paths, components, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.catalog.carriers import CALLS, CONTAINS, EDGES, INHERITS, NODES, TRANSITIONS
from codegrove.catalog.registry import query
from codegrove.operators import components as C
from codegrove.operators import graph_build as B
from codegrove.operators import graph_lookup as L
from codegrove.operators import metrics as M
from codegrove.operators import modularity as Q
from codegrove.operators import sketches as K
from codegrove.operators import traversal as V
from codegrove.plans.retrieval import CodeRetriever
from codegrove.sources import graph_store as GS
from codegrove.sources import tables as D
from codegrove.staging import Stage


def graph(spark, sf):
    return D.order_nodes(spark, sf), D.order_edges(spark, sf)


def transitions(spark, sf):
    edges = Stage(spark, "transitions").table(D.transition_edges(spark, sf))
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges


# --- listings and lookups ---------------------------------------------------------------------------


@query("nodes_by_type", "P4 P12 P13", f"WITH {NODES} SELECT id, name FROM nodes WHERE node_type = 'class'")
def nodes_by_type(spark, sf):
    return L.nodes_of_type(D.order_nodes(spark, sf), "class").select("id", "name")


@query("edges_by_type", "P5 P14", f"WITH {EDGES} SELECT src, dst FROM edges WHERE edge_type IN ('inherits', 'imports')")
def edges_by_type(spark, sf):
    return L.edges_of_type(D.order_edges(spark, sf), "inherits", "imports").select("src", "dst")


@query(
    "node_and_edge_lookup", "P6 P10 P11",
    f"""WITH {NODES}, {EDGES} SELECT 'node' AS kind, id, name AS detail FROM nodes WHERE id = 'nation:3'
    UNION ALL SELECT 'edge', src || '>' || dst, edge_type FROM edges WHERE src = 'customer:1' AND dst = (SELECT 'nation:' || c_nationkey FROM customer WHERE c_custkey = 1)""",
)
def node_and_edge_lookup(spark, sf):
    nodes, edges = graph(spark, sf)
    c = D.table(spark, sf, "customer").filter("c_custkey = 1").select("c_nationkey").first()
    found = L.node(nodes, "nation:3").select(F.lit("node").alias("kind"), "id", F.col("name").alias("detail"))
    between = L.edges_between(edges, "customer:1", f"nation:{c[0]}")
    return found.unionByName(
        between.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id"), F.col("edge_type").alias("detail"))
    )


@query(
    "list_nodes", "P15 P23 T13",
    f"""WITH {NODES}, fullest AS (SELECT file_path, count(*) AS n FROM nodes WHERE node_type = 'function' GROUP BY 1 ORDER BY n DESC, file_path LIMIT 1)
    SELECT id, name, qualified_name, node_type, file_path, 1 AS line_start FROM nodes WHERE node_type = 'function' AND file_path = (SELECT file_path FROM fullest)
    ORDER BY id LIMIT 20 OFFSET 2""",
)
def list_nodes(spark, sf):
    nodes = D.order_nodes(spark, sf)
    # the file with the most functions: there is one at every size
    fullest = nodes.filter("node_type = 'function'").groupBy("file_path").count().orderBy(F.desc("count"), "file_path").first()
    rows = L.list_nodes(nodes, "function", fullest.file_path, 20, 2)
    return rows.select(*L.node_info()).drop("line_end")


@query(
    "list_edges", "P16 T25",
    f"""WITH {CALLS} SELECT src, dst, 'calls' AS edge_type FROM calls""",
)
def list_edges(spark, sf):
    return L.list_edges(D.order_edges(spark, sf)).select("src", "dst", "edge_type")


@query(
    "list_files", "P17",
    f"WITH {NODES} SELECT file_path, count(*) AS units FROM nodes WHERE file_path IN (SELECT DISTINCT file_path FROM nodes WHERE regexp_full_match(file_path, 'customers/1.*')) GROUP BY 1",
)
def list_files(spark, sf):
    nodes = D.order_nodes(spark, sf)
    files = L.list_files(nodes, "customers/1*")
    return nodes.join(files, "file_path", "left_semi").groupBy("file_path").agg(F.count(F.lit(1)).alias("units"))


@query(
    "known_nodes_edges", "P8 P9",
    f"""WITH {NODES}, {CALLS}, asked AS (SELECT DISTINCT 'part:' || (2 * p_partkey) AS id FROM part),
    pairs AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || (l_partkey + l_linenumber % 2) AS dst FROM lineitem)
    SELECT 'node' AS kind, id AS a, '' AS b, id IN (SELECT id FROM nodes) AS known FROM asked
    UNION ALL SELECT 'edge', src, dst, (src, dst) IN (SELECT (src, dst) FROM calls) FROM pairs""",
)
def known_nodes_edges(spark, sf):
    """Every second part number twice as high, and for every order line its part or the one after it."""
    ids = D.table(spark, sf, "part").select(F.concat(F.lit("part:"), 2 * F.col("p_partkey")).alias("id"))
    pairs = D.table(spark, sf, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey") + F.col("l_linenumber") % 2).alias("dst")
    )
    nodes, edges = graph(spark, sf)
    found = L.known_nodes(nodes, ids).select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), "known")
    of_pairs = L.known_edges(L.edges_of_type(edges, "calls"), pairs)
    return found.unionByName(of_pairs.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "known"))


@query("file_nodes", "P18", f"WITH {NODES} SELECT id, name, node_type FROM nodes WHERE file_path = 'nations.py'")
def file_nodes(spark, sf):
    return L.file_nodes(D.order_nodes(spark, sf), "nations.py").select("id", "name", "node_type")


@query(
    "neighbors", "J6 J7 J8 U4",
    f"""WITH {EDGES} SELECT 'out' AS side, dst AS id FROM (SELECT DISTINCT dst FROM edges WHERE src = 'nation:3')
    UNION ALL SELECT 'in', src FROM (SELECT DISTINCT src FROM edges WHERE dst = 'nation:3')
    UNION ALL SELECT 'any', id FROM (SELECT dst AS id FROM edges WHERE src = 'nation:3' UNION SELECT src FROM edges WHERE dst = 'nation:3')""",
)
def neighbors(spark, sf):
    nodes, edges = graph(spark, sf)
    sides = {"out": L.successors, "in": L.predecessors, "any": L.neighbors}
    frames = [f(nodes, edges, "nation:3").select(F.lit(s).alias("side"), "id") for s, f in sides.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "incident_edges", "J9 J10",
    f"WITH {EDGES} SELECT src, dst, edge_type FROM edges WHERE src = 'part:1' UNION ALL SELECT src, dst, edge_type FROM edges WHERE dst = 'supplier:1'",
)
def incident_edges(spark, sf):
    edges = D.order_edges(spark, sf).select("src", "dst", "edge_type")
    return L.outgoing(edges, "part:1").unionByName(L.incoming(edges, "supplier:1"))


_SPANS = """spans AS (
  SELECT 'orders/' || o_orderkey AS file_path, 'order:' || o_orderkey AS id, 1 AS line_start, 60 AS line_end FROM orders
  UNION ALL SELECT 'orders/' || l_orderkey, 'line:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey, l_linenumber * 7, l_linenumber * 7 + 6 FROM lineitem),
pos AS (SELECT DISTINCT 'orders/' || l_orderkey AS file_path, CAST(l_quantity AS INTEGER) AS line FROM lineitem)"""


@query(
    "position_lookup", "P19",
    f"""WITH {_SPANS} SELECT file_path, line, arg_min(id, (line_end - line_start, line_start, id)) AS innermost, arg_min(id, (line_start, id)) AS first
    FROM pos JOIN spans USING (file_path) WHERE line BETWEEN line_start AND line_end GROUP BY ALL""",
)
def position_lookup(spark, sf):
    o = D.table(spark, sf, "orders").select(
        F.concat(F.lit("orders/"), F.col("o_orderkey")).alias("file_path"), F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"),
        F.lit(1).alias("line_start"), F.lit(60).alias("line_end"),
    )
    li = D.table(spark, sf, "lineitem")
    path = F.concat(F.lit("orders/"), F.col("l_orderkey")).alias("file_path")
    inner = li.select(
        path, F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        (F.col("l_linenumber") * 7).alias("line_start"), (F.col("l_linenumber") * 7 + 6).alias("line_end"),
    )
    spans = o.unionByName(inner)
    pos = li.select(path, F.col("l_quantity").cast("int").alias("line"))
    return L.at_positions(spans, pos)


@query(
    "expand_local", "J20 J25 J26",
    f"""WITH {CALLS}, ctx AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size >= 40),
    a AS (SELECT src, dst FROM calls WHERE dst IN (SELECT id FROM ctx)), b AS (SELECT src, dst FROM calls WHERE src IN (SELECT id FROM ctx))
    SELECT src AS source, dst AS target, src || ' calls ' || dst AS description FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def expand_local(spark, sf):
    ctx = D.table(spark, sf, "part").filter("p_size >= 40").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"))
    return L.related(ctx, D.order_edges(spark, sf)).select("source", "target", "description")


@query(
    "siblings", "J21",
    f"WITH {CONTAINS} SELECT DISTINCT a.dst AS id, b.dst AS sibling FROM contain a JOIN contain b ON a.src = b.src AND a.dst <> b.dst WHERE a.dst LIKE 'nation:%'",
)
def siblings(spark, sf):
    ids = D.table(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("id"))
    return L.siblings(D.order_edges(spark, sf), ids)


@query("mutual_pairs", "J23", f"WITH {TRANSITIONS} SELECT DISTINCT a.src AS a, a.dst AS b FROM trans a JOIN trans b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_pairs(spark, sf):
    return L.mutual_pairs(D.transition_edges(spark, sf))


# --- traversal --------------------------------------------------------------------------------------


def _reach_sql(start: str, steps: str, depth: int) -> str:
    """Breadth-first levels over a table ``steps(src, dst)`` as a recursive query."""
    return f"""b(id, depth) AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT s.dst, depth + 1 FROM b JOIN {steps} s ON s.src = b.id WHERE depth < {depth}),
    levels AS (SELECT id, min(depth) AS depth FROM b GROUP BY id)"""


@query(
    "callers_khop", "V1 V7 J25 T4",
    f"WITH RECURSIVE {CALLS}, inv AS (SELECT dst AS src, src AS dst FROM calls), {_reach_sql('supplier:3', 'inv', 2)} SELECT id, depth FROM levels WHERE depth > 0",
)
def callers_khop(spark, sf):
    return V.callers(*graph(spark, sf), "supplier:3", 2).select("id", "depth")


@query(
    "callees_khop", "V2 J26",
    f"WITH RECURSIVE {CALLS}, {_reach_sql('order:11', 'calls', 20)} SELECT id, depth FROM levels WHERE depth > 0",
)
def callees_khop(spark, sf):
    return V.callees(*graph(spark, sf), "order:11").select("id", "depth")


@query(
    "inheritance", "V3 V4 V17",
    f"""WITH RECURSIVE {INHERITS}, inv AS (SELECT dst AS src, src AS dst FROM inherit), {_reach_sql('nation:7', 'inherit', 20)},
    d(id, depth) AS (SELECT 'nation:7', 0 UNION SELECT s.dst, depth + 1 FROM d JOIN inv s ON s.src = d.id WHERE depth < 20)
    SELECT 'ancestors' AS direction, id, depth FROM levels WHERE depth > 0 UNION ALL SELECT 'descendants', id, min(depth) FROM d WHERE depth > 0 GROUP BY id""",
)
def inheritance(spark, sf):
    return V.inheritance_hierarchy(*graph(spark, sf), "nation:7").select("direction", "id", "depth")


@query(
    "dependencies_dependents", "V5 V6",
    f"""WITH {EDGES} SELECT 'needs' AS side, dst AS id FROM (SELECT DISTINCT dst FROM edges WHERE src = 'supplier:5' AND edge_type IN ('calls', 'imports', 'inherits'))
    UNION ALL SELECT 'needed_by', dst FROM (SELECT DISTINCT dst FROM edges WHERE src = 'supplier:5' AND edge_type IN ('called_by', 'imported_by', 'inherited_by'))""",
)
def dependencies_dependents(spark, sf):
    nodes, edges = graph(spark, sf)
    a = V.dependencies(nodes, edges, "supplier:5").select(F.lit("needs").alias("side"), "id")
    return a.unionByName(V.dependents(nodes, edges, "supplier:5").select(F.lit("needed_by").alias("side"), "id"))


@query(
    "ego_graph", "V10 V7",
    f"""WITH RECURSIVE {CALLS}, both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), {_reach_sql('order:5', 'both_ways', 2)}
    SELECT 'node' AS kind, id AS a, CAST(depth AS VARCHAR) AS b FROM levels
    UNION ALL SELECT 'edge', src, dst FROM calls WHERE src IN (SELECT id FROM levels) AND dst IN (SELECT id FROM levels)""",
)
def ego_graph(spark, sf):
    nodes, edges = V.ego_graph(*graph(spark, sf), "order:5", 2, ("calls",))
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("depth").cast("string").alias("b"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(
    "ego_graph_budget", "V11",
    f"WITH RECURSIVE {CALLS}, both_ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), {_reach_sql('part:9', 'both_ways', 2)} SELECT id, depth FROM levels ORDER BY depth, id LIMIT 50",
)
def ego_graph_budget(spark, sf):
    nodes, _ = V.ego_graph(*graph(spark, sf), "part:9", 2, ("calls",), "both", 50)
    return nodes.select("id", "depth")


def _connected_ends(spark, sf):
    """The first nation and the first part that an order connects: there are such ends at every size."""
    orders = D.table(spark, sf, "customer").join(D.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    lines = orders.join(D.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    row = lines.agg(F.min(F.struct("c_nationkey", "l_partkey")).alias("ends")).first().ends
    return f"nation:{row.c_nationkey}", f"part:{row.l_partkey}"


@query(
    "shortest_path", "V8 V12 T5",
    f"""WITH RECURSIVE {EDGES}, st AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('contains', 'calls')),
    ends AS (SELECT 'nation:' || c_nationkey AS first, 'part:' || l_partkey AS last FROM customer JOIN orders ON o_custkey = c_custkey
      JOIN lineitem ON l_orderkey = o_orderkey ORDER BY c_nationkey, l_partkey LIMIT 1),
    b(id, depth) AS (SELECT first, 0 FROM ends UNION SELECT s.dst, depth + 1 FROM b JOIN st s ON s.src = b.id WHERE depth < 4)
    SELECT CAST(min(depth) AS INTEGER) AS hops, CAST(min(depth) AS DOUBLE) AS total_weight, first, last FROM b JOIN ends ON id = last GROUP BY first, last""",
)
def shortest_path(spark, sf):
    source, target = _connected_ends(spark, sf)
    p = V.shortest_path(D.order_edges(spark, sf), source, target, ("contains", "calls"))
    return p.select("hops", "total_weight", F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"))


@query(
    "all_paths", "V9 T5",
    f"""WITH RECURSIVE {TRANSITIONS}, p(id, path, w) AS (SELECT 'click@0', ['click@0'], 0.0::DOUBLE UNION ALL
      SELECT t.dst, list_append(path, t.dst), w + weight FROM p JOIN trans t ON t.src = p.id WHERE p.id <> 'view@1' AND len(path) < 5 AND NOT list_contains(path, t.dst))
    SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops, w AS total_weight FROM p WHERE id = 'view@1'""",
)
def all_paths(spark, sf):
    p = V.all_paths(D.transition_edges(spark, sf), "click@0", "view@1", 5)
    return p.select(F.array_join("path", ">").alias("path"), "hops", "total_weight")


_IMPACT = f"""WITH RECURSIVE {NODES}, {CALLS}, inv AS (SELECT dst AS src, src AS dst FROM calls), {_reach_sql('supplier:9', 'inv', 3)},
    imp AS (SELECT n.id, n.name, n.file_path, n.node_type, depth AS distance FROM levels JOIN nodes n USING (id) WHERE depth > 0)"""


@query(
    "impact", "V14 U3",
    f"{_IMPACT} SELECT id, name, distance, CASE distance WHEN 1 THEN 'direct' ELSE 'indirect' END AS impact_type FROM imp",
)
def impact(spark, sf):
    return V.impact(*graph(spark, sf), "supplier:9", 3).select("id", "name", "distance", "impact_type")


@query(
    "impact_summary", "V14 A8",
    f"""{_IMPACT} SELECT count(*) AS total_affected, count(*) FILTER (distance = 1) AS direct_count, count(*) FILTER (distance > 1) AS indirect_count,
    count(DISTINCT file_path) AS files_affected, round(least(1.0, sum(CASE node_type WHEN 'class' THEN 2.0 WHEN 'module' THEN 3.0 ELSE 1.0 END)::DOUBLE / ((SELECT count(*) FROM nodes) * 0.5::DOUBLE)), 3) AS impact_score FROM imp""",
)
def impact_summary(spark, sf):
    nodes, edges = graph(spark, sf)
    rows = Stage(spark, "impact").table(V.impact(nodes, edges, "supplier:9", 3))
    score = V.impact_score(rows.withColumnRenamed("code_type", "node_type"), nodes)
    return V.impact_summary(rows).withColumn("impact_score", score.scalar())


def _impact_paths_sql(nodes: int) -> str:
    """Paths of at most so many nodes from supplier:9 to what depends on it within so many steps."""
    return f"""WITH RECURSIVE {EDGES}, all_steps AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM edges WHERE src <> dst GROUP BY src, dst),
    needed AS (SELECT src, dst FROM edges WHERE edge_type IN ('called_by', 'imported_by', 'inherited_by')), {_reach_sql('supplier:9', 'needed', nodes)},
    targets AS (SELECT id FROM levels WHERE depth > 0),
    p(id, path, w) AS (SELECT 'supplier:9', ['supplier:9'], 0.0::DOUBLE UNION ALL
      SELECT t.dst, list_append(path, t.dst), w + weight FROM p JOIN all_steps t ON t.src = p.id WHERE len(path) < {nodes} AND NOT list_contains(path, t.dst)),
    found AS (SELECT id, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops, w AS total_weight FROM p WHERE id IN (SELECT id FROM targets))"""


@query("impact_paths", "V13", f"{_impact_paths_sql(3)} SELECT * FROM found")
def impact_paths(spark, sf):
    found = V.impact_paths(*graph(spark, sf), "supplier:9", 3)
    return found.select("id", F.array_join("path", ">").alias("path"), "hops", "total_weight")


@query(
    "impact_paths_best", "V13",
    f"""{_impact_paths_sql(4)} SELECT id, path, hops, total_weight FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops, string_split(path, '>')) AS n FROM found) WHERE n <= 3""",
)
def impact_paths_best(spark, sf):
    found = V.impact_paths(*graph(spark, sf), "supplier:9", 4, per_node=3)
    return found.select("id", F.array_join("path", ">").alias("path"), "hops", "total_weight")


@query(
    "call_hierarchy", "V16",
    f"""WITH RECURSIVE {CALLS}, inv AS (SELECT dst AS src, src AS dst FROM calls), {_reach_sql('part:5', 'inv', 3)},
    d(id, depth) AS (SELECT 'part:5', 0 UNION SELECT s.dst, depth + 1 FROM d JOIN calls s ON s.src = d.id WHERE depth < 3)
    SELECT 'callers' AS direction, id FROM levels WHERE depth > 0 UNION ALL SELECT DISTINCT 'callees', id FROM d WHERE depth > 0""",
)
def call_hierarchy(spark, sf):
    return V.call_hierarchy(*graph(spark, sf), "part:5").select("direction", "id")


@query(
    "dependency_star", "V15 J23",
    f"""WITH {CALLS}, i AS (SELECT src FROM calls WHERE dst = 'part:8'), o AS (SELECT dst FROM calls WHERE src = 'part:8')
    SELECT src AS source, 'part:8' AS target FROM i UNION ALL SELECT 'part:8', dst FROM o""",
)
def dependency_star(spark, sf):
    return V.dependency_star(*graph(spark, sf), "part:8", "both", 1)


@query(
    "hierarchy", "V18",
    f"""WITH RECURSIVE {CONTAINS}, l AS (SELECT src, dst FROM contain),
    t(id, parent_id, depth, path) AS (SELECT 'region:' || r_regionkey, CAST(NULL AS VARCHAR), 0, 'region:' || r_regionkey FROM region UNION ALL
      SELECT l.dst, t.id, depth + 1, path || '/' || l.dst FROM t JOIN l ON l.src = t.id)
    SELECT * FROM t""",
)
def hierarchy(spark, sf):
    roots = D.table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("id"))
    rows = V.containment_tree(D.order_edges(spark, sf), roots)
    return rows.withColumn("path", F.array_join("path", "/"))


@query(
    "by_relationship", "J22",
    f"""WITH {CALLS}, {NODES}, r AS (SELECT 'callees' AS relationship, dst AS id FROM calls WHERE src = 'part:21' UNION SELECT 'callers', src FROM calls WHERE dst = 'part:21'
      UNION SELECT 'ancestors', 'nation:' || c_nationkey FROM customer WHERE c_custkey = 7
      UNION SELECT 'descendants', 'customer:' || c_custkey FROM customer WHERE c_nationkey = 3
      UNION SELECT 'siblings', 'nation:' || n_nationkey FROM nation WHERE n_nationkey <> 3 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)
      UNION SELECT 'self', 'part:21')
    SELECT relationship, id, 0.8::DOUBLE AS score FROM r JOIN nodes USING (id)""",
)
def by_relationship(spark, sf):
    """Every relationship a question can ask for, through the retriever."""
    stage = Stage(spark, "relationships")
    nodes, edges = (stage.table(t) for t in graph(spark, sf))
    texts = nodes.select("id", "name", "qualified_name", F.col("node_type").alias("code_type"), "file_path", "line_start", "line_end").withColumns(
        {"content": F.lit(""), "language": F.lit(""), "docstring": F.lit("")}
    )
    found = CodeRetriever(texts, nodes, edges)
    asked = [
        ("part:21", "callees"), ("part:21", "callers"), ("customer:7", "ancestors"), ("nation:3", "descendants"),
        ("nation:3", "siblings"), ("part:21", "self"),
    ]
    rows = [
        found.by_relationship(code_id, name).select(F.lit(name).alias("relationship"), F.col("code_id").alias("id"), F.col("relevance_score").alias("score"))
        for code_id, name in asked
    ]
    return reduce(DataFrame.unionByName, rows)


# --- components and metrics --------------------------------------------------------------------------


@query(
    "wcc_chains", "V22",
    "SELECT conv_id || ':' || turn AS id, min(conv_id || ':' || turn) OVER (PARTITION BY conv_id) AS component FROM (SELECT DISTINCT conv_id, turn FROM conversations)",
)
def wcc_chains(spark, sf):
    return C.weak_components(D.turn_nodes(spark, sf), D.turn_edges(spark, sf))


@query(
    "wcc_sizes", "V22 A1",
    """WITH used AS (SELECT DISTINCT p FROM (SELECT 'part:' || l_partkey AS p FROM lineitem UNION ALL SELECT 'order:' || l_orderkey FROM lineitem UNION ALL SELECT 'supplier:' || l_suppkey FROM lineitem)),
    alone AS (SELECT id FROM (SELECT 'part:' || p_partkey AS id FROM part UNION ALL SELECT 'order:' || o_orderkey FROM orders UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier
      UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region) WHERE id NOT IN (SELECT p FROM used))
    SELECT min(p) AS component, count(*) AS size FROM used UNION ALL SELECT id, 1 FROM alone""",
)
def wcc_sizes(spark, sf):
    nodes, edges = graph(spark, sf)
    return C.component_sizes(C.weak_components(nodes, L.edges_of_type(edges, "calls")))


_REACHABLE = f"""{TRANSITIONS}, r(a, b) AS (SELECT id, id FROM states UNION SELECT r.a, t.dst FROM r JOIN trans t ON t.src = r.b),
    comp AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query("scc", "V20", f"WITH RECURSIVE {_REACHABLE} SELECT id, component FROM comp")
def scc(spark, sf):
    return C.strong_components(*transitions(spark, sf))


@query(
    "cycles", "V21",
    f"WITH RECURSIVE {_REACHABLE}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1) SELECT id, component, size FROM comp JOIN z USING (component) WHERE size > 1",
)
def cycles(spark, sf):
    return C.cycles(*transitions(spark, sf))


@query(
    "betweenness", "A3 T6",
    f"""WITH RECURSIVE {TRANSITIONS},
    r(s, v, d) AS (SELECT id, id, 0 FROM states UNION SELECT r.s, t.dst, d + 1 FROM r JOIN trans t ON t.src = r.v WHERE d < 25),
    dist AS (SELECT s, v, min(d) AS d FROM r GROUP BY ALL),
    dag AS (SELECT a.s, a.v AS u, b.v AS w FROM dist a JOIN trans t ON t.src = a.v JOIN dist b ON b.s = a.s AND b.v = t.dst AND b.d = a.d + 1),
    walk(s, v) AS (SELECT id, id FROM states UNION ALL SELECT walk.s, g.w FROM walk JOIN dag g ON g.s = walk.s AND g.u = walk.v),
    sig AS (SELECT s, v, count(*) AS n FROM walk GROUP BY ALL),
    part_sums AS (SELECT m.v AS id, sum(a.n * b.n / c.n::DOUBLE) AS raw FROM dist m JOIN dist o ON o.s = m.v JOIN dist f ON f.s = m.s AND f.v = o.v AND f.d = m.d + o.d
      JOIN sig a ON a.s = m.s AND a.v = m.v JOIN sig b ON b.s = m.v AND b.v = o.v JOIN sig c ON c.s = m.s AND c.v = o.v
      WHERE m.v <> m.s AND m.v <> o.v AND m.s <> o.v GROUP BY 1)
    SELECT id, round(coalesce(raw, 0) / (((SELECT count(*) FROM states) - 1.0) * ((SELECT count(*) FROM states) - 2.0)), 6) AS score FROM states LEFT JOIN part_sums USING (id)""",
)
def betweenness(spark, sf):
    return M.centrality(*transitions(spark, sf)).select("id", F.round("score", 6).alias("score"))


def _rings(spark, sf):
    """Conversations of three turns or more whose last turn calls the first: one ring each, so components grow with the table."""
    chain = D.turn_edges(spark, sf).select("src", "dst")
    ends = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).filter("b - a >= 2")
    return D.turn_nodes(spark, sf), chain.unionByName(ends.select(F.concat_ws(":", "conv_id", "b").alias("src"), F.concat_ws(":", "conv_id", "a").alias("dst")))


_RINGS = """t AS (SELECT DISTINCT conv_id, turn, conv_id || ':' || turn AS id FROM conversations),
    n AS (SELECT conv_id, min(id) AS low, max(turn) - min(turn) AS far, count(*) AS size FROM t GROUP BY conv_id)"""


@query(
    "scc_rings", "V20",
    f"WITH {_RINGS} SELECT id, CASE WHEN far >= 2 AND size = far + 1 THEN low ELSE id END AS component FROM t JOIN n USING (conv_id)",
)
def scc_rings(spark, sf):
    return C.strong_components(*_rings(spark, sf)).select("id", "component")


@query("cycles_rings", "V21", f"WITH {_RINGS} SELECT id, low AS component, size FROM t JOIN n USING (conv_id) WHERE far >= 2 AND size = far + 1")
def cycles_rings(spark, sf):
    return C.cycles(*_rings(spark, sf)).select("id", "component", "size")


@query(
    "closeness", "A3 T6",
    """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations),
    r(conv_id, first, turn, d) AS (SELECT conv_id, turn, turn, 0 FROM t UNION ALL SELECT r.conv_id, first, t.turn, d + 1 FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1),
    s AS (SELECT conv_id || ':' || first AS id, count(*) - 1 AS reached, sum(d)::DOUBLE AS distance, coalesce(sum(1.0::DOUBLE / d) FILTER (d > 0), 0) AS harmonic FROM r GROUP BY 1)
    SELECT id, reached, distance, round(CASE WHEN reached = 0 THEN 0 ELSE reached / distance * (reached / ((SELECT count(*) FROM t) - 1.0::DOUBLE)) END, 9) AS closeness,
      round(harmonic, 6) AS harmonic FROM s""",
)
def closeness(spark, sf):
    found = K.closeness(D.turn_nodes(spark, sf), D.turn_edges(spark, sf))
    return found.select("id", "reached", "distance", F.round("closeness", 9).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))


_DEGREE = f"""{NODES}, {EDGES}, pr AS (SELECT DISTINCT src, dst FROM edges),
    i AS (SELECT dst AS id, count(*) AS n FROM pr GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM pr GROUP BY 1),
    deg AS (SELECT id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id))"""


@query("degree_centrality", "A3 T6", f"WITH {_DEGREE} SELECT id, in_degree, out_degree, (in_degree + out_degree)::DOUBLE AS score FROM deg")
def degree_centrality(spark, sf):
    return M.degrees(*graph(spark, sf)).select("id", "in_degree", "out_degree", "score")


@query("hub_nodes", "A5", f"WITH {_DEGREE} SELECT id, in_degree + out_degree AS connections FROM deg WHERE in_degree + out_degree >= 50")
def hub_nodes(spark, sf):
    return M.hubs(*graph(spark, sf), 50).select("id", F.col("score").cast("bigint").alias("connections"))


@query("isolated_nodes", "A6", f"WITH {NODES}, {CALLS} SELECT id, name FROM nodes WHERE id NOT IN (SELECT src FROM calls UNION SELECT dst FROM calls)")
def isolated_nodes(spark, sf):
    nodes, edges = graph(spark, sf)
    return M.isolated(nodes, L.edges_of_type(edges, "calls")).select("id", "name")


@query("dead_code", "A7", f"WITH {NODES}, {CALLS} SELECT id FROM nodes WHERE node_type IN ('function', 'method') AND name NOT LIKE '\\_\\_%' ESCAPE '\\' AND id NOT IN (SELECT dst FROM calls)")
def dead_code(spark, sf):
    return M.dead_code(*graph(spark, sf)).select("id")


@query(
    "coupling_metrics", "A4",
    f"""WITH {NODES}, {EDGES}, a AS (SELECT src AS id, count(DISTINCT dst) AS n FROM edges WHERE edge_type IN ('called_by', 'imported_by', 'inherited_by') GROUP BY 1),
    e AS (SELECT src AS id, count(DISTINCT dst) AS n FROM edges WHERE edge_type IN ('calls', 'imports', 'inherits') GROUP BY 1),
    c AS (SELECT id, coalesce(a.n, 0) AS ca, coalesce(e.n, 0) AS ce FROM nodes LEFT JOIN a USING (id) LEFT JOIN e USING (id))
    SELECT id, ca AS afferent_coupling, ce AS efferent_coupling, round(CASE WHEN ca + ce > 0 THEN ce / (ca + ce)::DOUBLE ELSE 0 END, 6) AS instability FROM c""",
)
def coupling_metrics(spark, sf):
    rows = M.coupling(*graph(spark, sf))
    return rows.select(
        "id", F.col("afferent_coupling").cast("bigint").alias("afferent_coupling"),
        F.col("efferent_coupling").cast("bigint").alias("efferent_coupling"), F.round("instability", 6).alias("instability"),
    )


@query(
    "graph_type_counts", "A1 P12",
    f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, node_type AS type, count(*) AS count FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ALL",
)
def graph_type_counts(spark, sf):
    return M.type_counts(*graph(spark, sf))


@query(
    "graph_stats", "A1 A2 V22",
    f"""WITH {NODES}, {EDGES}, n AS (SELECT count(*) AS c, count(DISTINCT file_path) AS f FROM nodes), e AS (SELECT count(*) AS c FROM edges)
    SELECT n.c AS node_count, e.c AS edge_count, n.f AS files_count, round(e.c / (n.c::DOUBLE * (n.c - 1)), 9) AS density, round(2.0 * e.c / n.c, 6)::DOUBLE AS avg_degree,
    CAST(1 + (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS BIGINT) AS connected_components FROM n, e""",
)
def graph_stats(spark, sf):
    row = M.graph_stats(*graph(spark, sf))
    return row.withColumn("density", F.round("density", 9)).withColumn("avg_degree", F.round("avg_degree", 6))


@query(
    "communities", "V23 V24",
    """WITH t AS (SELECT DISTINCT conv_id, conv_id || ':' || turn AS id FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS rn FROM t)
    SELECT min(id) AS community_id, count(*) AS size, array_to_string(list(id ORDER BY id) FILTER (rn <= 5), ',') AS key_members FROM r GROUP BY conv_id""",
)
def communities(spark, sf):
    nodes = D.turn_nodes(spark, sf)
    members = Stage(spark, "members").table(C.weak_components(nodes, D.turn_edges(spark, sf)))
    rows = C.community_list(members, nodes, 5)
    return rows.select("community_id", "size", F.array_join("key_members", ",").alias("key_members"))


@query(
    "community_members", "V24",
    """WITH t AS (SELECT DISTINCT conv_id, conv_id || ':' || turn AS id FROM conversations), n AS (SELECT DISTINCT conv_id || ':' || turn AS id, role || '_' || turn AS name FROM conversations)
    SELECT min(t.id) OVER (PARTITION BY conv_id) AS community_id, t.id, n.name FROM t JOIN n ON t.id = n.id""",
)
def community_members(spark, sf):
    nodes = D.turn_nodes(spark, sf)
    members = Stage(spark, "members").table(C.weak_components(nodes, D.turn_edges(spark, sf)))
    return C.community_members(members, nodes).select("community_id", "id", "name")


@query(
    "community_summary", "A13 A14 G3 V24",
    """WITH t AS (SELECT conv_id, conv_id || ':' || turn AS id, role || '_' || turn AS name, role FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS rn FROM t),
    m AS (SELECT conv_id, role, count(*) AS n, min(rn) AS a FROM r GROUP BY ALL), b AS (SELECT conv_id, arg_max(role, (n, -a)) AS role FROM m GROUP BY 1)
    SELECT min(id) AS community_id, 'Community ' || min(id) AS name, 'Primarily contains ' || b.role || 's across 1 file(s)' AS description,
    array_to_string(list(r.name ORDER BY rn) FILTER (rn <= 5), ',') AS key_components, count(*) AS size FROM r JOIN b USING (conv_id) GROUP BY conv_id, b.role""",
)
def community_summary(spark, sf):
    nodes = D.turn_nodes(spark, sf)
    members = Stage(spark, "members").table(C.weak_components(nodes, D.turn_edges(spark, sf)))
    return C.community_summary(members, nodes).withColumn("key_components", F.array_join("key_components", ","))


_PLACED = f"""{NODES}, {EDGES}, home AS (SELECT id, min(node_type) AS c FROM nodes GROUP BY id),
    l AS (SELECT src AS u, dst AS v, count(*) AS w FROM edges GROUP BY ALL), b AS (SELECT u, v, w FROM l UNION ALL SELECT v, u, w FROM l),
    p AS (SELECT coalesce(x.c, u) AS c, coalesce(y.c, v) AS d, w FROM b LEFT JOIN home x ON x.id = u LEFT JOIN home y ON y.id = v),
    s AS (SELECT c, sum(w)::DOUBLE AS total, coalesce(sum(w) FILTER (c = d), 0)::DOUBLE AS inside FROM p GROUP BY c)"""


@query(
    "modularity", "V23 A13",
    f"""WITH {_PLACED} SELECT (SELECT count(DISTINCT c) FROM home) AS communities,
    round((SELECT sum(inside) / sum(total) - sum((total / (SELECT sum(total) FROM s)) ** 2) FROM s), 9) AS modularity""",
)
def modularity(spark, sf):
    """How well the kinds of nodes part the graph of orders."""
    nodes, edges = graph(spark, sf)
    kinds = nodes.groupBy("id").agg(F.min("node_type").alias("community"))
    return Q.modularity(kinds, edges).withColumn("modularity", F.round("modularity", 9))


@query("modular_communities", "V23")
def modular_communities(spark, sf):
    """Communities of the whole graph of orders, by modularity."""
    return Q.modular_communities(*graph(spark, sf))


# --- maintenance ------------------------------------------------------------------------------------


@query(
    "keep_known_edges", "J5 S22",
    f"WITH {EDGES} SELECT src, dst, edge_type FROM edges WHERE src NOT LIKE 'order:%' AND dst NOT LIKE 'order:%'",
)
def keep_known_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    return B.keep_known_edges(edges, nodes.filter("node_type <> 'method'")).select("src", "dst", "edge_type")


@query(
    "add_remove_nodes", "J27 J28",
    f"""WITH {NODES}, {EDGES}, big AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 5000)
    SELECT 'node' AS kind, id AS a, '' AS b FROM nodes WHERE id NOT IN (SELECT id FROM big) UNION ALL SELECT 'node', 'extra:' || r_regionkey, '' FROM region
    UNION ALL SELECT 'edge', src, dst FROM edges WHERE src NOT IN (SELECT id FROM big) AND dst NOT IN (SELECT id FROM big)""",
)
def add_remove_nodes(spark, sf):
    nodes, edges = graph(spark, sf)
    gone = D.table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("id"))
    kept, left = B.remove_nodes(nodes, edges, gone)
    regions = D.table(spark, sf, "region")
    new = regions.select(F.concat(F.lit("extra:"), F.col("r_regionkey")).alias("id")).unionByName(
        regions.select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("id"))
    )
    rows = B.add_nodes(kept, new).select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"))
    return rows.unionByName(left.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(
    "graph_json", "S14 S15 S21 S22 F31",
    f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, id AS a, node_type AS b FROM nodes UNION ALL SELECT 'edge', src || '>' || dst, edge_type FROM edges",
)
def graph_json(spark, sf):
    """The whole graph through JSON files of a store."""
    store = GS.GraphStore(spark, f"{Stage(spark, 'json').base}/graphs")
    store.export_json("orders", *graph(spark, sf), compress=True)
    n, e = store.import_json("orders")
    rows = n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("node_type").alias("b"))
    return rows.unionByName(e.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("a"), F.col("edge_type").alias("b")))
