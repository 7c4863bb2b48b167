"""Mergeable sketches: quantiles per group and period, and closeness by growing neighbourhoods (inventory A3 T6, §2.13).

Sketches have a fixed size whatever they have seen, and merge without loss, so they are stored once and united for any range later. All of it is
Spark's own aggregate functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.staging import Stage


def quantile_sketches(rows: DataFrame, groups: list[str], value: str, k: int = 800) -> DataFrame:
    """``groups`` and ``sketch``: a KLL sketch of a number in each group. Rank error about 1.65 / k ** 0.9 with 99 % confidence; nulls are left out."""
    numbers = rows.filter(F.col(value).isNotNull())
    return numbers.groupBy(*groups).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, groups: list[str], probabilities: list[float], k: int = 800) -> DataFrame:
    """``groups``, n, p, value: quantiles of the united sketches, one row for each probability."""
    merged = sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("all"))
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("all", F.lit(p)).alias("value")) for p in probabilities])
    return merged.select(*groups, F.kll_sketch_get_n_double("all").alias("n"), F.inline(pairs))


def closeness(nodes: DataFrame, edges: DataFrame, lg_k: int = 12, max_rounds: int | None = None) -> DataFrame:
    """(id, reached, distance, closeness, harmonic) of every node, along the edges' direction, by HyperBall (Boldi and Vigna, 2013).

    Every node has one distinct-count sketch of the nodes within r steps. A round unites it with those of its neighbours whose sketch grew in the
    round before, so a round costs the edges into changed nodes and no row per pair of nodes exists. ``reached`` counts others,
    ``distance`` sums the steps to them, closeness is reached / distance scaled by the share of the graph reached, harmonic the sum of 1 / steps.
    Relative standard error of a count: 1.04 / sqrt(2 ** lg_k); small counts are exact.
    """
    stage = Stage(nodes.sparkSession, "balls")
    ids = nodes.select("id").distinct()
    steps = stage.table(edges.filter("src <> dst").select("src", "dst").distinct())
    zero = F.lit(0.0)
    balls = ids.groupBy("id").agg(F.hll_sketch_agg("id", lg_k).alias("ball")).select(
        "id", "ball", F.lit(1).cast("long").alias("size"), zero.alias("distance"), zero.alias("harmonic"), F.lit(True).alias("grew")
    )
    balls, seen = stage.put(balls, grew=F.count_if("grew"))
    n, r = seen["rows"], 0
    while seen["rows"] and seen["grew"] and (max_rounds is None or r < max_rounds):
        r += 1
        sent = balls.filter("grew").select(F.col("id").alias("dst"), "ball")
        # partial aggregation unites the balls that reach a hub before they are sent
        came = steps.join(sent, "dst").groupBy(F.col("src").alias("id")).agg(F.hll_union_agg("ball").alias("came"))
        both = balls.drop("grew").join(came, "id", "left").withColumn(
            "next", F.when(F.col("came").isNull(), F.col("ball")).otherwise(F.hll_union("ball", "came"))
        )
        both = both.withColumn("more", F.greatest(F.hll_sketch_estimate("next"), F.col("size")))
        growth = (F.col("more") - F.col("size")).cast("double")
        balls, seen = stage.put(both.select(
            "id", F.col("next").alias("ball"), F.col("more").alias("size"), (F.col("distance") + growth * r).alias("distance"),
            (F.col("harmonic") + growth / r).alias("harmonic"), (growth > 0).alias("grew"),
        ), grew=F.count_if("grew"))
    reached = F.col("size") - 1
    share = F.try_divide(reached.cast("double"), F.lit(float(max(n - 1, 1))))
    return balls.select(
        "id", reached.alias("reached"), "distance", F.coalesce(F.try_divide(reached, F.col("distance")) * share, zero).alias("closeness"), "harmonic"
    )
