"""Point and one-hop lookups on the graph tables (inventory P4-P19, P23, J6-J10, J20-J26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.functions import text as T
from codegrove.operators.filters import page


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    """P4."""
    return nodes.filter(F.col("node_type") == kind)


def edges_of_type(edges: DataFrame, *kinds: str) -> DataFrame:
    """P5: a partition filter when the edge table is stored by edge_type."""
    return edges.filter(F.col("edge_type").isin(*kinds))


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """P6."""
    return nodes.filter(F.col("id") == node_id).limit(1)


def has_node(nodes: DataFrame, node_id: str) -> bool:
    """P8."""
    return not node(nodes, node_id).isEmpty()


def known_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """P8 for many ids at once: (id, known) of each distinct id."""
    return _known(nodes, ids, "id")


def known_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """P9 for many pairs at once: (src, dst, known) of each distinct pair."""
    return _known(edges, pairs, "src", "dst")


def _known(present: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """One aggregate over both sides: neither is made distinct or sorted for a join. A key with a null is never known."""
    rows = asked.select(*keys, F.lit(True).alias("asked")).unionByName(present.select(*keys, F.lit(False).alias("asked")).dropna())
    seen = rows.groupBy(*keys).agg(F.max("asked").alias("asked"), F.min("asked").alias("only"))
    return seen.filter("asked").select(*keys, (~F.col("only")).alias("known"))


def edges_between(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All edges of a pair, each with its own type."""
    return edges.filter((F.col("src") == src) & (F.col("dst") == dst))


def has_edge(edges: DataFrame, src: str, dst: str) -> bool:
    """P9."""
    return not edges_between(edges, src, dst).isEmpty()


def outgoing(edges: DataFrame, node_id: str) -> DataFrame:
    """J9."""
    return edges.filter(F.col("src") == node_id)


def incoming(edges: DataFrame, node_id: str) -> DataFrame:
    """J10."""
    return edges.filter(F.col("dst") == node_id)


def successors(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Nodes one edge away, each once."""
    return nodes.join(outgoing(edges, node_id).select(F.col("dst").alias("id")), "id", "left_semi")


def predecessors(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """J7."""
    return nodes.join(incoming(edges, node_id).select(F.col("src").alias("id")), "id", "left_semi")


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Both directions, each node once."""
    touching = edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
    other = F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src"))
    return nodes.join(touching.select(other.alias("id")), "id", "left_semi")


def list_nodes(
    nodes: DataFrame, kind: str | None = None, file_path: str | None = None, limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Filters first, then the page, in id order."""
    if kind:
        nodes = nodes_of_type(nodes, kind)
    if file_path:
        nodes = nodes.filter(F.col("file_path") == file_path)
    return page(nodes, limit, offset, "id")


def _first_of(rows: DataFrame, group: str, order: str, n: int | None) -> DataFrame:
    """The first rows of each group, or all."""
    if n is None:
        return rows
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def list_edges(
    edges: DataFrame, kind: str = "calls", src: str | None = None, dst: str | None = None,
    limit: int | None = None, per_node: int | None = None, sample_nodes: int | None = None,
) -> DataFrame:
    """Edges of one end, or all edges; on request a sample (first nodes by id, a few edges each)."""
    rows = edges_of_type(edges, kind)
    if src:
        return page(outgoing(rows, src), limit, 0, "dst")
    if dst:
        return page(incoming(rows, dst), limit, 0, "src")
    if sample_nodes is not None:
        rows = rows.join(rows.select("src").distinct().orderBy("src").limit(sample_nodes), "src", "left_semi")
    return page(_first_of(rows, "src", "dst", per_node), limit, 0, "src", "dst")


def list_files(nodes: DataFrame, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct file paths, optionally by glob."""
    files = nodes.select("file_path").filter(F.col("file_path").isNotNull())
    if pattern:
        files = files.filter(T.matches_glob(F.col("file_path"), pattern))
    return page(files.distinct(), limit, 0, "file_path")


def file_nodes(nodes: DataFrame, file_path: str) -> DataFrame:
    """P18."""
    return nodes.filter(F.col("file_path") == file_path)


def indexed_files(
    documents: DataFrame, pattern: str | None = None, language: str | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """(file_path, languages, units, lines) of the files in the index, by path, optionally by glob and language."""
    if pattern:
        documents = documents.filter(T.matches_glob(F.col("file_path"), pattern))
    if language:
        documents = documents.filter(F.col("language") == language)
    files = documents.groupBy("file_path").agg(
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.count(F.lit(1)).alias("units"), F.max("line_end").cast("long").alias("lines")
    )
    return page(files, limit, offset, "file_path")


def file_info(documents: DataFrame, file_path: str) -> DataFrame:
    """The row of one file, or none."""
    return indexed_files(documents.filter(F.col("file_path") == file_path))


def node_info() -> list[Column]:
    """The listing projection."""
    return [
        F.col("id"), F.col("name"), F.coalesce("qualified_name", "name").alias("qualified_name"),
        F.col("node_type"), F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("line_start", F.lit(0)).alias("line_start"),
        F.coalesce("line_end", F.lit(0)).alias("line_end"),
    ]


def at_position(nodes: DataFrame, positions: DataFrame, innermost: bool = False) -> DataFrame:
    """For each (file_path, line) the ``id`` of the first node of the file, or the innermost, whose span holds the line."""
    return at_positions(nodes, positions).select("file_path", "line", F.col("innermost" if innermost else "first").alias("id"))


def at_positions(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """For each (file_path, line) the ``first`` and the ``innermost`` node whose span holds the line, in one pass.

    A range join without pairing whole files: a span of up to 2^k lines is stored under the one or two
    blocks of 2^k lines it touches, and a line looks into its block at each size that occurs. Only spans
    of about the right size next to the line are compared. The choice among the hits is a partially
    aggregated ``min_by``: first in the file, and the narrowest.
    """
    width = F.col("line_end") - F.col("line_start")
    level = F.when(width < 1, 0).otherwise(F.ceil(F.log2(width + 1))).cast("int")
    rank = F.struct(width.alias("w"), F.col("line_start").alias("s"), F.col("id").alias("i"))
    spans = nodes.filter(F.col("line_end") >= F.col("line_start")).select(
        "file_path", "id", "line_start", "line_end", rank.alias("rank"), level.alias("level")
    )

    def block(line: Column) -> Column:
        return F.floor(line / F.pow(F.lit(2.0), F.col("level"))).cast("long")

    stored = spans.withColumn(
        "block", F.explode(F.array_distinct(F.array(block(F.col("line_start")), block(F.col("line_end")))))
    )
    # at most 32 different sizes exist, whatever the data
    sizes = spans.agg(F.collect_set("level")).scalar()
    lines = positions.select("file_path", "line").distinct().withColumn("level", F.explode(sizes))
    lines = lines.withColumn("block", block(F.col("line")))
    inside = (F.col("line_start") <= F.col("line")) & (F.col("line") <= F.col("line_end"))
    return (
        lines.join(stored, ["file_path", "level", "block"])
        .filter(inside)
        .groupBy("file_path", "line")
        .agg(F.min_by("id", F.struct("rank.s", "rank.i")).alias("first"), F.min_by("id", "rank").alias("innermost"))
    )


def related(contexts: DataFrame, edges: DataFrame, per_node: int | None = None) -> DataFrame:
    """Callers and callees of each context, all or a few each, as (source, target) pairs once."""
    ids = contexts.select(F.col("id").alias("ctx")).distinct()
    calls = edges_of_type(edges, "calls").select("src", "dst").distinct()

    def side(own: str, other: str) -> DataFrame:
        rows = calls.select(F.col(own).alias("ctx"), F.col(other).alias("other")).join(
            ids, "ctx", "left_semi"
        )
        return _first_of(rows, "ctx", "other", per_node).select(F.col("ctx").alias(own), F.col("other").alias(other))

    pairs = side("dst", "src").unionByName(side("src", "dst")).distinct()
    return pairs.select(
        F.col("src").alias("source"), F.col("dst").alias("target"),
        F.array(F.struct(F.col("dst").alias("node"), F.lit("CALLS").alias("edge_type"))).alias("path"),
        F.concat_ws(" calls ", "src", "dst").alias("description"),
    )


def children(edges: DataFrame, node_id: str) -> DataFrame:
    return outgoing(edges_of_type(edges, "contains"), node_id).select(F.col("dst").alias("id"))


def siblings(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, sibling) pairs for a list of requested ids: other children of the same parent."""
    contains = edges_of_type(edges, "contains").select("src", "dst")
    own = contains.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    parents = own.select("src", F.col("dst").alias("id"))
    return (
        contains.join(parents, "src")
        .filter(F.col("dst") != F.col("id"))
        .select("id", F.col("dst").alias("sibling"))
        .distinct()
    )


def mutual_pairs(edges: DataFrame, kind: str = "calls") -> DataFrame:
    """Unordered pairs connected in both directions, found by one aggregation, no self-join."""
    rows = edges_of_type(edges, kind).filter(F.col("src") != F.col("dst"))
    return (
        rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("f"),
             F.max((F.col("src") > F.col("dst")).cast("int")).alias("r"))
        .filter((F.col("f") == 1) & (F.col("r") == 1))
        .select("a", "b")
    )
