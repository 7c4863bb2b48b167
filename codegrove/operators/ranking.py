"""Ranking by rules over positional postings (inventory R2): words, typing errors, proximity, field, exactness.

The rules are compared one after the other, so no weights are needed: more of the question's words first, then fewer typing errors, then words that
stand closer together, then the more important field, then fields that consist of nothing else. Only postings of the question's words
are read; a document's rows are grouped once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.operators.search import FIELD_WEIGHTS


def smallest_window(events: Column, words: int) -> Column:
    """Positions spanned by the smallest stretch with all ``words`` words, null if one is missing.

    ``events``: ascending (pos, nth). For each event the last place of every word is known; the stretch that ends here begins at the
    least of them.
    """
    start = F.struct(F.array_repeat(F.lit(-1), words).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, event: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == event["nth"], event["pos"]).otherwise(v))
        return F.struct(last.alias("last"), F.least(state["best"], F.when(F.array_min(last) >= 0, event["pos"] - F.array_min(last) + 1)).alias("best"))

    return F.aggregate(events, start, step, lambda state: state["best"])


def ranked(matching: DataFrame, words: int) -> DataFrame:
    """id, words, typos, proximity, field_rank, exact of every document with a word; ``matching``: from ``WordIndex.matching``."""
    field_rank = reduce(lambda c, f: c.when(F.col("field") == f[1], f[0]), enumerate(FIELD_WEIGHTS), F.when(F.lit(False), -1)).otherwise(len(FIELD_WEIGHTS))
    placed = F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("nth").alias("nth")))
    per_field = matching.withColumn("placed", placed).groupBy("id", "field", "length").agg(
        F.array_sort(F.flatten(F.collect_list("placed"))).alias("events"), F.collect_list(F.struct("nth", "edits")).alias("met")
    )
    per_field = per_field.select("id", field_rank.alias("field_rank"), "length", "met", smallest_window(F.col("events"), words).alias("window"))
    whole = (F.col("length") == words) & (F.col("window") == words)
    per_doc = per_field.groupBy("id").agg(
        F.flatten(F.collect_list("met")).alias("met"), F.min("window").alias("proximity"), F.min("field_rank").alias("field_rank"),
        F.coalesce(F.max(whole), F.lit(False)).alias("exact"),
    )
    least = F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda i: F.array_min(F.transform(F.filter("met", lambda m: m["nth"] == i), lambda m: m["edits"])),
    )
    found = F.filter(least, lambda e: e.isNotNull())
    return per_doc.select(
        "id", F.size(found).alias("words"), F.aggregate(found, F.lit(0), lambda a, e: a + e).alias("typos"), "proximity", "field_rank", "exact"
    )


def best(matching: DataFrame, words: int, limit: int | None = None) -> DataFrame:
    """``ranked`` in the order of the rules, ties by id."""
    rows = ranked(matching, words).orderBy(
        F.desc("words"), "typos", F.asc_nulls_last("proximity"), "field_rank", F.desc("exact"), "id"
    )
    return rows if limit is None else rows.limit(limit)


def typo_scores(matching: DataFrame, n_documents: Column) -> DataFrame:
    """(id, keyword_score): the keyword score of the engine, each word standing for all terms within its typing errors."""
    weights = F.create_map(*[F.lit(x) for item in FIELD_WEIGHTS.items() for x in item])
    hits = matching.select("nth", "id", (F.size("positions") * weights[F.col("field")]).alias("wtf"))
    per_doc = hits.groupBy("nth", "id").agg(F.sum("wtf").alias("wtf"))
    # one row per word of the question
    frequency = per_doc.groupBy("nth").agg(F.count(F.lit(1)).alias("df"))
    return (
        per_doc.join(F.broadcast(frequency), "nth").groupBy("id")
        .agg(F.sum(F.col("wtf") * F.log1p(n_documents / F.col("df"))).alias("keyword_score"))
    )
