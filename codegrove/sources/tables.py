"""Readers for the supplied tables and the carriers that give each abstraction real rows.

The tables hold no source code, so every engine abstraction is derived from them by plain
DataFrame expressions: documents become units, parts become named symbols, and the order schema
becomes a typed dependency graph as well as a small source-code project rendered as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrove.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search units; the language decides the unit type."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"),
        F.concat_ws(".", "source", F.concat(F.lit("doc_"), F.col("doc_id"))).alias(
            "qualified_name"
        ),
        F.when(F.col("lang") == "en", "function")
        .when(F.col("lang") == "de", "class")
        .when(F.col("lang") == "fr", "method")
        .otherwise("module")
        .alias("code_type"),
        F.concat_ws("/", "source", "lang").alias("file_path"),
        F.lit(1).alias("line_start"),
        F.size(T.lines(F.col("text"))).alias("line_end"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.concat(F.col("lang"), F.lit("("), F.col("n_chars"), F.lit(")")).alias("signature"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("docstring"),
    )


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as named symbols: snake-case names, brand-qualified, one per part."""
    p = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return p.select(
        F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"),
        name.alias("name"),
        F.concat(F.col("p_brand"), F.lit("."), name).alias("qualified_name"),
        F.lower("p_type").alias("code_type"),
        F.col("p_brand").alias("language"),
        F.concat(F.lower("p_brand"), F.lit("/"), F.lower("p_type"), F.lit("/"), name, F.lit(".py"))
        .alias("file_path"),
        F.col("p_size").alias("line_start"),
        (F.col("p_size") + 9).alias("line_end"),
        F.col("p_partkey").alias("seq"),
    )


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column))


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed nodes: region=module, nation/customer=class, order=method, part/supplier=function."""
    spec = [
        ("region", "region", "r_regionkey", "r_name", "module", F.lit("regions.py")),
        ("nation", "nation", "n_nationkey", "n_name", "class", F.lit("nations.py")),
        ("customer", "customer", "c_custkey", "c_name", "class",
         F.concat(F.lit("customers/"), F.col("c_nationkey"), F.lit(".py"))),
        ("supplier", "supplier", "s_suppkey", "s_name", "function",
         F.concat(F.lit("suppliers/"), F.col("s_nationkey"), F.lit(".py"))),
        ("part", "part", "p_partkey", "p_name", "function",
         F.concat(F.lit("parts/"), F.lower("p_brand"), F.lit(".py"))),
        ("order", "orders", "o_orderkey", "o_orderpriority", "method",
         F.concat(F.lit("orders/"), F.year("o_orderdate"), F.lit(".py"))),
    ]
    frames = []
    for prefix, source, key, name, node_type, path in spec:
        frames.append(
            table(spark, sf_dir, source).select(
                _key(prefix, key).alias("id"),
                F.col(name).alias("name"),
                F.concat(F.lit(f"{source}."), F.col(name)).alias("qualified_name"),
                F.lit(node_type).alias("node_type"),
                path.alias("file_path"),
                F.lit(1).alias("line_start"),
                F.lit(10).alias("line_end"),
                F.lit(None).cast("string").alias("metadata"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calls of the order graph: order -> part and part -> supplier."""
    li = table(spark, sf_dir, "lineitem")
    # made distinct as numbers: only these are shuffled, the texts are made afterwards
    first = li.select("l_orderkey", "l_partkey").distinct()
    second = li.select("l_partkey", "l_suppkey").distinct()
    return first.select(_key("order", "l_orderkey").alias("src"), _key("part", "l_partkey").alias("dst")).unionByName(
        second.select(_key("part", "l_partkey").alias("src"), _key("supplier", "l_suppkey").alias("dst"))
    )


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent/child rows of the containment tree region > nation > customer > order, and suppliers."""
    pairs = [
        ("nation", "region", "n_regionkey", "nation", "n_nationkey"),
        ("customer", "nation", "c_nationkey", "customer", "c_custkey"),
        ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"),
        ("orders", "customer", "o_custkey", "order", "o_orderkey"),
    ]
    frames = [
        table(spark, sf_dir, source).select(_key(p, pk).alias("src"), _key(c, ck).alias("dst"))
        for source, p, pk, c, ck in pairs
    ]
    return reduce(DataFrame.unionByName, frames)


def inheritance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer inherits nation, nation inherits region."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return c.select(_key("customer", "c_custkey").alias("src"), _key("nation", "c_nationkey").alias("dst")).unionByName(
        n.select(_key("nation", "n_nationkey").alias("src"), _key("region", "n_regionkey").alias("dst"))
    )


def import_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier imports its nation (no inverse edge, as for all imports)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(_key("supplier", "s_suppkey").alias("src"), _key("nation", "s_nationkey").alias("dst"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed edges of the order graph, mirrored where the data model has an inverse."""

    def typed(pairs: DataFrame, edge_type: str, inverse: str | None) -> DataFrame:
        out = pairs.select("src", "dst", F.lit(edge_type).alias("edge_type"))
        if inverse:
            out = out.unionByName(
                pairs.select(
                    F.col("dst").alias("src"), F.col("src").alias("dst"),
                    F.lit(inverse).alias("edge_type"),
                )
            )
        return out

    frames = [
        typed(call_pairs(spark, sf_dir), "calls", "called_by"),
        typed(containment_pairs(spark, sf_dir), "contains", "contained_by"),
        typed(inheritance_pairs(spark, sf_dir), "inherits", "inherited_by"),
        typed(import_pairs(spark, sf_dir), "imports", None),
    ]
    return reduce(DataFrame.unionByName, frames).select(
        "src", "dst", "edge_type", F.lit(1.0).alias("weight"),
        F.lit(None).cast("string").alias("metadata"),
    )


def transition_edges(spark: SparkSession, sf_dir: str, by_week: bool = True) -> DataFrame:
    """Weighted cyclic digraph: each user's next event, summed over all users.

    States are event types, split by calendar week when ``by_week``. A busy user's history is cut by
    day: successors are found inside each (user, day), and the days of a user are linked through their
    first and last state, so no task orders one user's whole history.
    """
    from pyspark.sql import Window

    state = F.col("event_type")
    if by_week:
        week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
        state = F.concat(F.col("event_type"), F.lit("@"), week)
    ev = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), state.alias("src")
    )
    inside = ev.withColumn("dst", F.lead("src").over(Window.partitionBy("user_id", "day").orderBy("at")))
    days = ev.groupBy("user_id", "day").agg(
        F.min_by("src", "at").alias("first"), F.max_by("src", "at").alias("src")
    )
    across = days.withColumn("dst", F.lead("first").over(Window.partitionBy("user_id").orderBy("day")))
    pairs = inside.select("src", "dst").unionByName(across.select("src", "dst"))
    return (
        pairs.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .select("src", "dst", F.lit("calls").alias("edge_type"), "weight",
                F.lit(None).cast("string").alias("metadata"))
    )


def turn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.concat_ws("_", "role", "turn").alias("name"),
        F.col("role").alias("node_type"),
        F.concat(F.lit("conversations/"), F.col("conv_id")).alias("file_path"),
    )


def turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain of turns inside each conversation: turn t calls turn t+1 (equi-join, no window)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.join(nxt, ["conv_id", "turn"], "left_semi").select(
        F.concat_ws(":", "conv_id", "turn").alias("src"),
        F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("dst"),
        F.lit("calls").alias("edge_type"),
        F.lit(1.0).alias("weight"),
    )
