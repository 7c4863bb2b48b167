"""Prompt assembly under a token budget (inventory R15, G8, G9, F13, F26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.functions import prompts as P
from codegrove.functions import text as T


def prompt_items(contexts: DataFrame, relationships: DataFrame, communities: DataFrame) -> DataFrame:
    """All prompt parts as rows (kind, pos, body): contexts by relevance, the others in given order.

    The three inputs are results of one query: top-k lists of fixed length.
    """
    by_rank = Window.orderBy(F.desc("relevance_score"), "code_id")
    c = contexts.select(
        F.lit("contexts").alias("kind"), F.row_number().over(by_rank).alias("pos"),
        P.context_text().alias("body"),
    )
    r = relationships.select(
        F.lit("relationships").alias("kind"),
        F.row_number().over(Window.orderBy("source", "target")).alias("pos"),
        P.relationship_text(F.col("source"), F.col("target"), F.col("path"), F.col("description")).alias("body"),
    )
    m = communities.select(
        F.lit("communities").alias("kind"),
        F.row_number().over(Window.orderBy("community_id")).alias("pos"),
        P.community_text(F.col("name"), F.col("size"), F.col("description"), F.col("key_components")).alias("body"),
    )
    return c.unionByName(r).unionByName(m)


def within_budget(items: DataFrame, query_length: int, max_tokens: int, group: list[str] | None = None) -> DataFrame:
    """What is left after dropping parts until the estimate fits.

    Parts are dropped from the tail of a fixed order: contexts from the least relevant up to the
    second, then relationships, then communities, all from the end. Keeping the longest head of that
    order whose running length fits the budget gives the same set in one window. The best context is
    always kept; ``shrunk_best`` shortens it.
    """
    keep_order = (
        F.when((F.col("kind") == "contexts") & (F.col("pos") == 1), 0)
        .when(F.col("kind") == "communities", 1)
        .when(F.col("kind") == "relationships", 2)
        .otherwise(3)
    )
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy("keep_order", "pos").rowsBetween(Window.unboundedPreceding, 0)
    running = items.withColumn("keep_order", keep_order).withColumn("total", F.sum(F.length("body")).over(w))
    fits = F.floor((F.col("total") + query_length) / 4) <= max_tokens
    return running.filter(fits | (F.col("keep_order") == 0)).drop("keep_order", "total")


def shrunk_best(best: DataFrame, other_length: int, max_tokens: int, steps: int = 40) -> DataFrame:
    """G8, last phase: halve the code of the only context left until it fits or has five lines."""

    def rendered(content):
        shown = F.array_join(F.transform(F.slice(T.lines(content), 1, 30), lambda s: F.concat(F.lit("    "), s)), "\n")
        return F.length(F.col("_head")) + F.length(F.lit("\n  Code:\n")) + F.length(shown)

    def halve(content, _):
        rows = T.lines(content)
        half = F.concat(
            F.array_join(F.slice(rows, 1, F.floor(F.size(rows) / 2).cast("int")), "\n"),
            F.lit("\n... (truncated)"),
        )
        too_long = F.floor((rendered(content) + other_length) / 4) > max_tokens
        return F.when(too_long & (F.size(rows) > 5), half).otherwise(content)

    rows = best.withColumn("_head", P.context_text(include_content=False))
    return rows.withColumn(
        "content", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("content"), halve)
    ).drop("_head")


def user_prompt(
    items: DataFrame, query: str, query_type: str = "local", max_contexts: int | None = None,
    max_relationships: int | None = None, max_communities: int | None = None, group: list[str] | None = None,
) -> DataFrame:
    """The user prompt as one text per group, of all items or of the first of each section."""
    limits = {"contexts": max_contexts, "relationships": max_relationships, "communities": max_communities}
    if query_type == "global":
        del limits["relationships"]
    if query_type not in ("global", "drift"):
        del limits["communities"]
    shown = items.filter(
        F.coalesce(
            *[F.when((F.col("kind") == k) & (F.lit(True) if n is None else F.col("pos") <= n), True) for k, n in limits.items()], F.lit(False)
        )
    )

    def body(kind: str):
        part = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "body"))))
        return P.section(kind, F.array_join(F.transform(part, lambda s: s["body"]), "\n\n" if kind == "contexts" else "\n"))

    sections = [body(k) for k in ("contexts", "relationships", "communities") if k in limits]
    text = F.concat_ws("\n", *sections, P.section("query", F.lit(query)))
    return shown.groupBy(*(group or [])).agg(text.alias("user"))


def estimated_tokens(items: DataFrame, query: str, group: list[str] | None = None) -> DataFrame:
    """a quarter of all characters, of all items or of each group's."""
    return items.groupBy(*(group or [])).agg(
        F.floor((F.coalesce(F.sum(F.length("body")), F.lit(0)) + len(query)) / 4).alias("tokens")
    )
