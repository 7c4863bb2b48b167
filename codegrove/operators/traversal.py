"""Breadth-first operators (inventory V1-V19, J22).

Each level is one distributed step: frontier joined with the edges, what was seen before removed by
an anti join, the rest written to a staged table. Staged tables have known sizes, so Spark broadcasts
small frontiers by itself and shuffles large ones (skewed partitions are split by AQE). Results are
sets with a true depth: "reachable within k hops".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.operators.filters import page
from codegrove.operators.graph_lookup import edges_of_type
from codegrove.schemas import DEPENDENCY_EDGES, DEPENDENT_EDGES
from codegrove.staging import Stage


FOLDED = 8


@dataclass(frozen=True)
class TraversalOptions:
    """V7 parameters; ``max_depth`` < 0 means unlimited."""

    max_depth: int = -1
    edge_types: Sequence[str] | None = None
    node_types: Sequence[str] | None = None
    include_self: bool = False
    direction: str = "outgoing"  # outgoing | incoming | both


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def hops(edges: DataFrame, options: TraversalOptions) -> DataFrame:
    """Distinct (src, dst) steps allowed by the options, self loops left out."""
    rows = edges_of_type(edges, *options.edge_types) if options.edge_types is not None else edges
    forward = rows.select("src", "dst")
    backward = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if options.direction == "incoming":
        forward = backward
    elif options.direction == "both":
        forward = forward.unionByName(backward)
    return forward.filter(F.col("src") != F.col("dst"))


def reach(starts: DataFrame, steps: DataFrame, max_depth: int = -1, staged: bool = False) -> DataFrame:
    """(id, depth) of everything reachable from any start (depth 0), by levels. ``staged``: the steps are a written table already.

    Every ``FOLDED`` levels the visited nodes are written as one table, so that a long chain does not read one table per level in
    every round.
    """
    stage = Stage(_spark(steps), "reach")
    if max_depth != 1 and not staged:
        steps = stage.table(steps.select("src", "dst").distinct())
    frontier, seen = stage.put(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    levels = [frontier]
    depth = 0
    while seen["rows"] and (max_depth < 0 or depth < max_depth):
        depth += 1
        if len(levels) > FOLDED:
            levels = [stage.table(reduce(DataFrame.unionByName, levels))]
        visited = reduce(DataFrame.unionByName, levels)
        ahead = (
            steps.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(visited.select("id"), "id", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier, seen = stage.put(ahead)
        if seen["rows"]:
            levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def _one(df: DataFrame, node_id: str) -> DataFrame:
    return _spark(df).createDataFrame([(node_id,)], "id string")


def traverse(
    nodes: DataFrame, edges: DataFrame, start: str, options: TraversalOptions = TraversalOptions(), staged: bool = False
) -> DataFrame:
    """V7: nodes reachable from ``start`` with their depth; the type filter applies to the output only. ``staged``: see ``reach``."""
    found = reach(_one(nodes, start), hops(edges, options), options.max_depth, staged)
    if not options.include_self:
        found = found.filter(F.col("id") != start)
    if options.node_types is not None:
        nodes = nodes.filter(F.col("node_type").isin(*options.node_types))
    return nodes.join(found, "id")


def _closure(types: Sequence[str], default_depth: int):
    def run(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = default_depth) -> DataFrame:
        return traverse(nodes, edges, node_id, TraversalOptions(max_depth, types))

    return run


callers = _closure(("called_by",), -1)  # V1
callees = _closure(("calls",), -1)  # V2
ancestors = _closure(("inherits",), -1)  # V3
descendants = _closure(("inherited_by",), -1)  # V4
dependencies = _closure(DEPENDENCY_EDGES, 1)  # V5
dependents = _closure(DEPENDENT_EDGES, 1)  # V6


def induced_edges(edges: DataFrame, ids: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Edges with both ends inside a set of nodes."""
    rows = edges_of_type(edges, *types) if types is not None else edges
    inside = ids.select("id")
    return rows.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(
        inside.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def ego_graph(
    nodes: DataFrame, edges: DataFrame, center: str, max_depth: int = 2,
    types: Sequence[str] | None = None, direction: str = "both", max_nodes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, induced edges) around a node; an optional node budget keeps the nearest."""
    options = TraversalOptions(max_depth, types, include_self=True, direction=direction)
    found = traverse(nodes, edges, center, options)
    if max_nodes is not None:
        found = found.orderBy("depth", "id").limit(max_nodes)
    found = Stage(_spark(nodes), "ego").table(found)
    return found, induced_edges(edges, found, types)


def _weighted_steps(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    rows = edges_of_type(edges, *types) if types is not None else edges
    return rows.filter(F.col("src") != F.col("dst")).select("src", "dst", "weight")


def _distinct_steps(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """One row per connected pair with the smallest weight of its edges."""
    return _weighted_steps(edges, types).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def shortest_path(
    edges: DataFrame, source: str, target: str, types: Sequence[str] | None = None,
    max_nodes: int | None = None,
) -> DataFrame:
    """One row (path, hops, total_weight), or none; of equally short paths the smallest one.

    The frontier carries each node's smallest path; the loop ends when the target appears.
    """
    spark = _spark(edges)
    stage = Stage(spark, "path")
    steps = stage.table(_distinct_steps(edges, types))
    start = _one(edges, source).select(
        "id", F.array("id").alias("path"), F.lit(0.0).alias("total_weight")
    )
    here = F.max((F.col("id") == target).cast("int"))
    frontier, seen = stage.put(start, found=here)
    visited = [frontier.select("id")]
    while seen["rows"] and not seen["found"]:
        if max_nodes is not None and len(visited) >= max_nodes:
            break
        known = reduce(DataFrame.unionByName, visited)
        extended = steps.join(frontier.withColumnRenamed("id", "src"), "src").select(
            F.col("dst").alias("id"),
            F.struct(
                F.concat("path", F.array("dst")).alias("path"),
                (F.col("total_weight") + F.col("weight")).alias("total_weight"),
            ).alias("best"),
        )
        ahead = (
            extended.join(known, "id", "left_anti")
            .groupBy("id")
            .agg(F.min("best").alias("best"))
            .select("id", "best.path", "best.total_weight")
        )
        frontier, seen = stage.put(ahead, found=here)
        visited.append(frontier.select("id"))
    return frontier.filter(F.col("id") == target).select(
        "path", (F.size("path") - 1).alias("hops"), "total_weight"
    )


def all_paths(
    edges: DataFrame, source: str, target: str, max_nodes: int = 10,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """V9: every simple path with at most ``max_nodes`` nodes, as (path, hops, total_weight).

    A backward search first finds the nodes from which the target is still reachable and how far it
    is, so that partial paths which cannot arrive in time are never built.
    """
    spark = _spark(edges)
    stage = Stage(spark, "paths")
    steps = stage.table(_distinct_steps(edges, types))
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = reach(_one(edges, target), back, max(max_nodes - 1, 0), staged=True).select(
        F.col("id").alias("dst"), F.col("depth").alias("to_go")
    )
    useful = stage.table(steps.join(left, "dst"))
    frontier, seen = stage.put(
        _one(edges, source).select(
            "id", F.array("id").alias("path"), F.lit(0.0).alias("total_weight")
        )
    )
    done = [frontier.filter((F.col("id") == target) & (max_nodes >= 1))]
    length = 1
    while seen["rows"] and length < max_nodes:
        length += 1
        open_paths = frontier.filter(F.col("id") != target).withColumnRenamed("id", "src")
        ahead = (
            useful.join(open_paths, "src")
            .filter((F.col("to_go") <= max_nodes - length) & ~F.array_contains("path", F.col("dst")))
            .select(
                F.col("dst").alias("id"),
                F.concat("path", F.array("dst")).alias("path"),
                (F.col("total_weight") + F.col("weight")).alias("total_weight"),
            )
        )
        frontier, seen = stage.put(ahead)
        done.append(frontier.filter(F.col("id") == target))
    return reduce(DataFrame.unionByName, done).select(
        "path", (F.size("path") - 1).alias("hops"), "total_weight"
    )


def impact(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 3) -> DataFrame:
    """Callers with their true distance, direct or indirect, ordered by (distance, name)."""
    found = callers(nodes, edges, node_id, max_depth)
    return found.select(
        "id", "name", F.coalesce("qualified_name", "name").alias("qualified_name"),
        F.col("node_type").alias("code_type"), "file_path", F.col("depth").alias("distance"),
        F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("impact_type"),
    )


def impact_summary(affected: DataFrame) -> DataFrame:
    """Counts over the whole impact set."""
    return affected.agg(
        F.count(F.lit(1)).alias("total_affected"),
        F.count_if(F.col("distance") == 1).alias("direct_count"),
        F.count_if(F.col("distance") > 1).alias("indirect_count"),
        F.countDistinct("file_path").alias("files_affected"),
    )


def impact_score(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted share of the graph that depends on a node, capped at 1."""
    weight = F.when(F.col("node_type") == "class", 2.0).when(F.col("node_type") == "module", 3.0).otherwise(1.0)
    total = nodes.agg(F.count(F.lit(1)).cast("double")).scalar()
    share = F.coalesce(F.try_divide(F.sum(weight), total * 0.5), F.lit(0.0))
    return affected.agg(F.round(F.least(F.lit(1.0), share), 3).alias("impact_score"))


def paths_to_targets(
    edges: DataFrame, source: str, targets: DataFrame, max_nodes: int, per_target: int | None = None,
    types: Sequence[str] | None = None, staged: bool = False,
) -> DataFrame:
    """(id, path, hops, total_weight): the simple paths of at most ``max_nodes`` nodes from ``source`` to all ``targets`` (id) together.

    One enumeration serves all targets, level by level. A partial path is extended only where a target that still wants paths can be reached
    in the nodes that are left (the targets' common backward distance). With ``per_target`` the shortest paths of each target are kept, of
    equally long ones the smallest, and a target that has enough of them no longer asks for longer ones. Parallel edges are merged among those a
    round meets, not in the whole graph. ``staged``: the edges are a written table already.
    """
    spark = _spark(edges)
    stage = Stage(spark, "target-paths")
    steps = _weighted_steps(edges, types)
    steps = steps if staged else stage.table(steps)
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    wanted = stage.table(targets.select("id").distinct())
    frontier, seen = stage.put(_one(edges, source).select("id", F.array("id").alias("path"), F.lit(0.0).alias("total_weight")))
    done, length, to_go, full = [], 1, None, None
    while seen["rows"]:
        arrived = frontier.join(wanted, "id", "left_semi")
        if per_target is not None:
            order = Window.partitionBy("id").orderBy("path")
            had = F.lit(0) if full is None else F.coalesce("n", F.lit(0))
            arrived = arrived if full is None else arrived.join(full, "id", "left")
            arrived = arrived.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_target - had)
        arrived, came = stage.put(arrived.select("id", "path", "total_weight"))
        done.append(arrived)
        if length >= max_nodes:
            break
        length += 1
        if to_go is None or (per_target is not None and came["rows"]):
            if per_target is not None:
                counts = reduce(DataFrame.unionByName, done).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
                full = stage.table(counts)
                open_targets = wanted.join(full.filter(F.col("n") >= per_target), "id", "left_anti")
            else:
                open_targets = wanted
            to_go = stage.table(reach(open_targets, back, max_nodes - length, staged=True).select(F.col("id").alias("dst"), F.col("depth").alias("to_go")))
        # the steps out of the frontier first: while it is small it is sent to the steps, and only what it meets is moved. Both sides are plain
        # scans: the edges of a hub are many rows of one key, which Spark splits
        near = steps.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
        useful = near.join(to_go.filter(F.col("to_go") <= max_nodes - length).select("dst"), "dst", "left_semi")
        useful = useful.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
        ahead = useful.join(frontier.withColumnRenamed("id", "src"), "src").filter(~F.array_contains("path", F.col("dst")))
        frontier, seen = stage.put(ahead.select(
            F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), (F.col("total_weight") + F.col("weight")).alias("total_weight")
        ))
    return reduce(DataFrame.unionByName, done).select("id", "path", (F.size("path") - 1).alias("hops"), "total_weight")


def impact_paths(
    nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 3, per_node: int | None = None
) -> DataFrame:
    """The paths, of at most ``max_depth`` nodes, to all nodes that a change affects, as (id, path, hops, total_weight)."""
    known = Stage(_spark(edges), "impact-paths").table(edges.select("src", "dst", "edge_type", "weight"))
    affected = traverse(nodes, known, node_id, TraversalOptions(max_depth, DEPENDENT_EDGES), staged=True)
    return paths_to_targets(known, node_id, affected, max_depth, per_node, staged=True)


def call_hierarchy(
    nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", max_depth: int = 3
) -> DataFrame:
    """Callers and/or callees with a direction column."""
    frames = []
    if direction in ("callers", "both"):
        frames.append(callers(nodes, edges, node_id, max_depth).withColumn("direction", F.lit("callers")))
    if direction in ("callees", "both"):
        frames.append(callees(nodes, edges, node_id, max_depth).withColumn("direction", F.lit("callees")))
    return reduce(DataFrame.unionByName, frames)


def inheritance_hierarchy(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Ancestors and descendants with a direction column."""
    up = ancestors(nodes, edges, node_id).withColumn("direction", F.lit("ancestors"))
    return up.unionByName(descendants(nodes, edges, node_id).withColumn("direction", F.lit("descendants")))


def dependency_star(
    nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", depth: int = 2, limit: int | None = None
) -> DataFrame:
    """(source, target) edges between the centre and what it reaches, nearest first."""
    frames = []
    if direction in ("in", "both"):
        near = page(callers(nodes, edges, node_id, depth), limit, 0, "depth", "id")
        frames.append(near.select(F.col("id").alias("source"), F.lit(node_id).alias("target")))
    if direction in ("out", "both"):
        near = page(callees(nodes, edges, node_id, depth), limit, 0, "depth", "id")
        frames.append(near.select(F.lit(node_id).alias("source"), F.col("id").alias("target")))
    return reduce(DataFrame.unionByName, frames)


def containment_tree(
    edges: DataFrame, roots: DataFrame, max_depth: int | None = None, max_children: int | None = None,
    kind: str = "contains",
) -> DataFrame:
    """Rows (id, parent_id, depth, path) of the trees below some roots, children in id order.

    ``max_depth`` and ``max_children`` are limits of a listing; None keeps all.
    """
    spark = _spark(edges)
    stage = Stage(spark, "tree")
    links = edges_of_type(edges, kind).select(F.col("src").alias("parent_id"), F.col("dst").alias("id"))
    if max_children is not None:
        w = Window.partitionBy("parent_id").orderBy("id")
        links = links.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_children).drop("_rn")
    links = stage.table(links)
    level, seen = stage.put(
        roots.select(
            "id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"),
            F.array("id").alias("path"),
        )
    )
    levels = [level]
    while seen["rows"] and (max_depth is None or len(levels) <= max_depth):
        up = level.select(F.col("id").alias("parent_id"), F.col("depth").alias("d"), F.col("path").alias("p"))
        below = links.join(up, "parent_id").filter(~F.array_contains("p", F.col("id"))).select(
            "id", "parent_id", (F.col("d") + 1).alias("depth"), F.concat("p", F.array("id")).alias("path")
        )
        level, seen = stage.put(below)
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def outline(units: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Outline rows of every file: roots are units without a parent in their own file; all levels unless ``max_depth`` is given.

    ``sort_path`` orders a file's rows as a tree, children by line; nothing is collected.
    """
    spark = _spark(units)
    stage = Stage(spark, "outline")
    step = F.concat_ws(":", F.lpad(F.col("line_start").cast("string"), 8, "0"), F.col("id"))
    rows = stage.table(
        units.select("file_path", "id", "name", "type", "line_start", "line_end", "parent_id", step.alias("step"))
    )
    # one shuffle tells roots from the others
    parents = rows.select("file_path", F.col("id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    told, seen = stage.put(rows.join(parents, ["file_path", "parent_id"], "left").select(*rows.columns, "known"))
    level = told.filter("known is null").select(*rows.columns, F.lit(0).alias("depth"), F.array("step").alias("sort_path"))
    inner = told.filter("known").select(*rows.columns)
    levels = [level]
    while seen["rows"] and (max_depth is None or len(levels) <= max_depth):
        up = level.select(
            "file_path", F.col("id").alias("parent_id"), F.col("depth").alias("d"),
            F.col("sort_path").alias("p"),
        ).distinct()  # a unit met twice is one parent
        below = (
            inner.join(up, ["file_path", "parent_id"])
            .withColumn("depth", F.col("d") + 1)
            .withColumn("sort_path", F.concat("p", F.array("step")))
            .drop("d", "p")
        )
        level, seen = stage.put(below.select(*rows.columns, "depth", "sort_path"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).select(
        "file_path", "id", "name", F.col("type").alias("code_type"), "line_start", "line_end",
        "parent_id", "depth", F.array_join("sort_path", "/").alias("sort_path"),
    )
