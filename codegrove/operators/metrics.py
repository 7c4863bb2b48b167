"""Graph and index aggregates (inventory A1-A12, A15-A19, P12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.functions import text as T
from codegrove.operators.components import component_sizes, weak_components
from codegrove.operators.graph_lookup import edges_of_type
from codegrove.schemas import DEPENDENCY_EDGES, DEPENDENT_EDGES
from codegrove.staging import Stage


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: (kind, type, count) rows for nodes and edges."""
    n = nodes.groupBy(F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("count"))
    e = edges.groupBy(F.col("edge_type").alias("type")).agg(F.count(F.lit(1)).alias("count"))
    return n.select(F.lit("node").alias("kind"), "type", "count").unionByName(
        e.select(F.lit("edge").alias("kind"), "type", "count")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, components: bool = True) -> DataFrame:
    """A1/A2: one row: counts, files, density e/(n(n-1)), average degree 2e/n, weak components."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.countDistinct("file_path").alias("files_count"))
    e = edges.agg(F.count(F.lit(1))).scalar()
    rows = n.withColumn("edge_count", e)
    size = F.col("node_count").cast("double")
    rows = rows.select(
        "node_count", "edge_count", "files_count",
        F.when(size > 1, F.col("edge_count") / (size * (size - 1))).otherwise(0.0).alias("density"),
        F.coalesce(F.try_divide(F.col("edge_count") * 2.0, size), F.lit(0.0)).alias("avg_degree"),
    )
    if components:
        found = component_sizes(weak_components(nodes, edges)).agg(F.count(F.lit(1))).scalar()
        rows = rows.withColumn("connected_components", found)
    return rows


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3 (degree, and "closeness" which means the same): distinct predecessors plus successors.

    Pairs are made distinct first, which spreads a hub's edges over all tasks; the per-node counts are
    then partial sums.
    """
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        )
    )
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return (
        nodes.join(counts, "id", "left")
        .fillna(0, ["in_degree", "out_degree"])
        .withColumn("score", (F.col("in_degree") + F.col("out_degree")).cast("double"))
    )


def centrality(nodes: DataFrame, edges: DataFrame, kind: str = "betweenness") -> DataFrame:
    """A3: (id, score)."""
    if kind in ("degree", "closeness"):
        return degrees(nodes, edges).select("id", "score")
    if kind == "betweenness":
        return betweenness(nodes, edges)
    raise ValueError(f"Unknown centrality type: {kind}")


def hubs(nodes: DataFrame, edges: DataFrame, minimum: int = 5) -> DataFrame:
    """A5: nodes with at least ``minimum`` connections."""
    return degrees(nodes, edges).filter(F.col("score") >= minimum)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods nobody calls, dunder names aside."""
    called = edges_of_type(edges, "called_by").filter(F.col("src") != F.col("dst"))
    candidates = nodes.filter(
        F.col("node_type").isin("function", "method") & ~F.col("name").startswith("__")
    )
    return candidates.join(called.select(F.col("src").alias("id")), "id", "left_anti")


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A4: afferent and efferent coupling over all nodes in one aggregation, and instability."""
    kinds = edges_of_type(edges, *DEPENDENCY_EDGES, *DEPENDENT_EDGES).filter("src <> dst")
    pairs = kinds.select(
        F.col("src").alias("id"), "dst",
        F.col("edge_type").isin(*DEPENDENT_EDGES).alias("inward"),
    ).distinct()
    counts = pairs.groupBy("id").agg(
        F.count_if("inward").alias("ca"), F.count_if(~F.col("inward")).alias("ce")
    )
    both = F.col("afferent_coupling") + F.col("efferent_coupling")
    return (
        nodes.select("id").join(counts, "id", "left")
        .select(
            "id", F.coalesce("ca", F.lit(0)).alias("afferent_coupling"),
            F.coalesce("ce", F.lit(0)).alias("efferent_coupling"),
        )
        .withColumn("instability", F.coalesce(F.try_divide(F.col("efferent_coupling").cast("double"), both), F.lit(0.0)))
        .withColumn("abstractness", F.lit(0.0))
    )


def betweenness(nodes: DataFrame, edges: DataFrame, normalise: bool = True) -> DataFrame:
    """A3: exact betweenness of a directed graph (Brandes, 2001), all sources side by side.

    Forward: rows (s, id, sigma) per level, path counts summed per (s, id). Backward: dependencies are
    passed from each level to the one before. Work and rows are those of the algorithm, O(V*E), but
    split over the cluster by (source, node); no task holds the graph.
    """
    spark = nodes.sparkSession
    stage = Stage(spark, "between")
    steps = stage.table(edges.filter("src <> dst").select("src", "dst").distinct())
    level, seen = stage.put(
        nodes.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")).distinct()
    )
    levels = [level]
    visited = level.select("s", "id")
    while seen["rows"]:
        ahead = (
            steps.join(level.withColumnRenamed("id", "src"), "src")
            .groupBy("s", F.col("dst").alias("id"))
            .agg(F.sum("sigma").alias("sigma"))
            .join(visited, ["s", "id"], "left_anti")
        )
        level, seen = stage.put(ahead)
        if seen["rows"]:
            levels.append(level)
            visited = visited.unionByName(level.select("s", "id"))
    parts = []
    below = None  # (s, dst, share): (1 + delta) / sigma of the level below
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        if below is None:
            rows = here.withColumn("delta", F.lit(0.0))
        else:
            passed = (
                steps.join(below, "dst")
                .join(here.select("s", F.col("id").alias("src")), ["s", "src"], "left_semi")
                .groupBy("s", F.col("src").alias("id"))
                .agg(F.sum("share").alias("share"))
            )
            rows = here.join(passed, ["s", "id"], "left").select(
                "s", "id", "sigma", (F.coalesce("share", F.lit(0.0)) * F.col("sigma")).alias("delta")
            )
        rows = stage.table(rows)
        if depth > 0:
            parts.append(rows.groupBy("id").agg(F.sum("delta").alias("delta")))
        below = rows.select("s", F.col("id").alias("dst"), ((F.col("delta") + 1.0) / F.col("sigma")).alias("share"))
    total = nodes.select("id", F.lit(0.0).alias("delta"))
    for part in parts:
        total = total.unionByName(part)
    n = nodes.agg(F.count(F.lit(1)).cast("double")).scalar()
    scale = F.when(n > 2, F.lit(1.0) / ((n - 1.0) * (n - 2.0))).otherwise(1.0) if normalise else F.lit(1.0)
    return total.groupBy("id").agg(F.sum("delta").alias("raw")).select("id", (F.col("raw") * scale).alias("score"))


def line_counts(text: Column) -> list[Column]:
    """Code, comment and blank lines; only ``#`` comments count."""
    rows = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.transform(T.lines(text), T.strip)
    )
    comment = lambda s: s.startswith("#")
    return [
        F.size(F.filter(rows, lambda s: (s != "") & ~comment(s))).alias("lines_of_code"),
        F.size(F.filter(rows, comment)).alias("comment_lines"),
        F.size(F.filter(rows, lambda s: s == "")).alias("blank_lines"),
    ]


def code_metrics(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Line counts, callers, callees and threshold hints of every unit."""
    pairs = edges_of_type(edges, "calls", "called_by").filter("src <> dst").select("src", "dst", "edge_type").distinct()
    counts = pairs.groupBy(F.col("src").alias("id")).agg(
        F.count_if(F.col("edge_type") == "called_by").alias("dependencies_in"),
        F.count_if(F.col("edge_type") == "calls").alias("dependencies_out"),
    )
    rows = units.select("id", "name", "file_path", *line_counts(F.col("content"))).join(counts, "id", "left")
    rows = rows.fillna(0, ["dependencies_in", "dependencies_out"])
    # The texts of the hints.
    hints = F.array_compact(
        F.array(
            F.when(F.col("lines_of_code") > 50, "Consider breaking this into smaller functions"),
            F.when(F.col("dependencies_out") > 10, "High number of dependencies - consider simplifying"),
            F.when(F.col("dependencies_in") > 20, "Many dependents - changes here have wide impact"),
        )
    )
    return rows.withColumn("suggestions", hints)


def index_stats(files: DataFrame) -> DataFrame:
    """Files and units by language, by suffix and in total, from one pass (grouping sets)."""
    rows = files.select(
        F.coalesce("language", F.lit("unknown")).alias("language"),
        T.suffix(F.col("file_path")).alias("suffix"), F.col("units"),
    )
    return rows.groupingSets(
        [["language"], ["suffix"], []], "language", "suffix"
    ).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("files"), F.sum("units").alias("units")
    )


def field_distribution(docs: DataFrame) -> DataFrame:
    """Documents, and for every field how many documents carry it, in one pass."""
    row = docs.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.array(
            *[F.struct(F.lit(c).alias("field"), F.count(c).alias("documents")) for c in docs.columns]
        ).alias("f"),
    )
    return row.select("total_documents", F.inline("f"))


def index_result(batches: DataFrame) -> DataFrame:
    """Totals over indexing batches."""
    return batches.agg(
        F.sum("indexed").alias("total_indexed"), F.sum("updated").alias("total_updated"),
        F.sum("deleted").alias("total_deleted"), F.sum("errors").alias("errors"),
    )


def token_totals(embedded: DataFrame) -> DataFrame:
    """Number of embedded texts and their tokens."""
    return embedded.agg(F.count(F.lit(1)).alias("texts"), F.sum("token_count").alias("total_tokens"))
