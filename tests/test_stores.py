import os
import re

from pyspark.sql import functions as F

from codegrove.catalog import graph_queries
from codegrove.operators import embedding_cache as EC
from codegrove.operators import snapshots as N
from codegrove.plans.retrieval import CodeAssistant, CodeRetriever, RetrievalSettings
from codegrove.sources import files as FS
from codegrove.sources import graph_store as GS
from codegrove.sources.index_store import DocumentIndex
from codegrove.sources.models import BatchEmbedder, CachedGenerator, MockEmbedder, with_retry
from codegrove.streaming import watch as W


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_graph_store(spark, make_graph, tmp_path):
    n, e = make_graph({"a": "class", "b": "function"}, [("a", "b", "calls"), ("a", "zz", "calls"), ("b", "a", "contains")])
    store = GS.create_store(spark, str(tmp_path))
    store.save("one", n, e, {"owner": "x"})
    nodes, edges, meta = store.load("one")
    assert nodes.count() == 2 and edges.count() == 3 and meta["owner"] == "x" and meta["version"] == "1.0"
    store.export_json("two", n, e, compress=True)
    nodes, edges = store.import_json("two")
    assert nodes.count() == 2 and edges.count() == 2  # the edge to a missing node is dropped
    assert store.names() == ["one", "two"] and store.exists("one") and store.delete("one") and not store.exists("one")
    write(f"{tmp_path}/doc.json", '{"version": 1, "graph": {"nodes": [{"id": "a", "name": "a", "metadata": {"k": "v"}}, {"id": "b"}],'
          ' "edges": [{"source": "a", "target": "b", "data": {"edge_type": "calls", "weight": 2.0}}, {"source": "a", "target": "q", "data": {}}]}}')
    nodes, edges = GS.read_single_document(spark, f"{tmp_path}/doc.json")
    assert nodes.count() == 2 and [(r.src, r.dst, r.weight) for r in edges.collect()] == [("a", "b", 2.0)]


def test_missing_state_is_empty(spark, tmp_path):
    defs, refs = GS.load_reference_index(spark, f"{tmp_path}/none")
    assert defs.count() == 0 and refs.count() == 0 and GS.load_state(spark, f"{tmp_path}/none").count() == 0


def test_snapshot_outcomes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, content_hash string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "file_path string, content_hash string")
    got = {r.file_path: r.status for r in N.compare(old, new).collect()}
    assert got == {"a": "deleted", "b": "unchanged", "c": "modified", "d": "added"}


def test_index_steps_are_idempotent(spark, tmp_path):
    index = DocumentIndex(spark, f"{tmp_path}/ix")
    rows = spark.createDataFrame([("1", "f", "x"), ("2", "g", "y")], "id string, file_path string, content string")
    assert index.documents().count() == 0
    index.change(upserts=rows, step="s-0")
    index.change(upserts=rows.withColumn("content", F.lit("new")).filter("id = '1'"), deleted_files=rows.select("file_path"), step="s-1")
    index.change(upserts=rows.withColumn("content", F.lit("new")).filter("id = '1'"), deleted_files=rows.select("file_path"), step="s-1")
    assert index.versions() == [0, 1]
    assert [(r.id, r.content) for r in index.documents().collect()] == [("1", "new")]
    index.update(spark.createDataFrame([("1", "renamed")], "id string, name string"))
    assert index.get("1").first()["name"] == "renamed" and index.get("1").first().content == "new"
    index.compact()
    assert index.versions() == [] and index.documents().count() == 1
    index.change(upserts=rows, step="s-1")  # folded already
    assert index.documents().count() == 1 and index.versions() == []
    index.delete_where(F.col("file_path") == "f")
    assert index.documents().count() == 0


def test_streaming_after_compaction_loses_nothing(spark, tmp_path):
    """Batches, a fold, and more batches of the same stream: every document stays."""
    src, index = f"{tmp_path}/src", DocumentIndex(spark, f"{tmp_path}/ix")
    for n in range(4):
        write(f"{src}/f{n}.py", f"def f{n}():\n    return {n}\n")
        W.wait(W.start(W.file_stream(spark, src), W.index_sink(index), f"{tmp_path}/cp"))
        if n == 2:
            index.compact()
        assert {r["name"] for r in index.documents().collect()} == {f"f{k}" for k in range(n + 1)}


def test_a_broken_fold_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("1", "f", "x"), ("2", "g", "y")], "id string, file_path string, content string")
    index = DocumentIndex(spark, f"{tmp_path}/ix")
    index.change(upserts=rows)
    index.change(deleted_ids=rows.filter("id = '1'"))
    os.makedirs(f"{tmp_path}/ix/base=2")  # begun, not complete
    assert [r.id for r in index.documents().collect()] == ["2"]
    index.compact()
    index.change(upserts=rows.filter("id = '1'"))
    assert sorted(r.id for r in index.documents().collect()) == ["1", "2"]


def test_state_is_read_whole(spark, tmp_path):
    one = spark.createDataFrame([("a", "h")], "file_path string, content_hash string")
    GS.save_state(one, f"{tmp_path}/s")
    os.makedirs(f"{tmp_path}/s/state=7")  # a writer died here
    assert [r.file_path for r in GS.load_state(spark, f"{tmp_path}/s").collect()] == ["a"]
    GS.save_state(GS.load_state(spark, f"{tmp_path}/s").withColumn("file_path", F.lit("b")), f"{tmp_path}/s")
    assert [r.file_path for r in GS.load_state(spark, f"{tmp_path}/s").collect()] == ["b"]


def test_skipped_files_are_not_opened(spark, tmp_path):
    write(f"{tmp_path}/p/a.py", "x = 1\n")
    write(f"{tmp_path}/p/node_modules/b.py", "y = 1\n")
    df = FS.source_files(spark, f"{tmp_path}/p")
    assert [r.file_path.rsplit("/", 1)[1] for r in df.collect()] == ["a.py"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = FS.source_files(spark, f"{tmp_path}/p")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # a filter on the file's own path is applied when files are listed
    assert re.search(r"DataFilters: \[.*Contains\(file_path#\d+, node_modules\)", plan)


def test_watch_and_refresh(spark, tmp_path):
    src = f"{tmp_path}/src"
    write(f"{src}/a.py", "def a():\n    return 1\n")
    write(f"{src}/b.py", "def b():\n    return a()\n")
    write(f"{src}/venv/skip.py", "def skip(): pass\n")
    index = DocumentIndex(spark, f"{tmp_path}/ix")
    state = f"{tmp_path}/state"
    assert W.refresh(spark, src, state, index) == {"added": 2, "modified": 0, "deleted": 0}
    assert {r["name"] for r in index.documents().collect()} == {"a", "b"}
    write(f"{src}/a.py", "def a2():\n    return 1\n")
    os.remove(f"{src}/b.py")
    assert W.refresh(spark, src, state, index) == {"added": 0, "modified": 1, "deleted": 1}
    assert {r["name"] for r in index.documents().collect()} == {"a2"}
    assert W.refresh(spark, src, state, index) == {"added": 0, "modified": 0, "deleted": 0}
    live = DocumentIndex(spark, f"{tmp_path}/live")
    for _ in range(2):  # the second run finds nothing new
        W.wait(W.start(W.file_stream(spark, src), W.fan_out([W.index_sink(live)]), f"{tmp_path}/cp"))
    assert {"a2"} <= {r["name"] for r in live.documents().collect()}
    assert FS.source_files(spark, src, languages=["python"]).count() == 1
    assert FS.file_hashes(spark, src, ("*.py",)).count() == 1 and FS.modification_times(spark, src).count() == 2


def test_cache_ttl_and_embedder(spark):
    rows = spark.createDataFrame([("h1", "c1", "u", "2024-01-01 00:00:00"), ("h2", "c2", "u", "2024-01-03 00:00:00")],
                                 "content_hash string, chunk_id string, unit_id string, created_at string")
    cache = rows.withColumn("created_at", F.col("created_at").cast("timestamp"))
    now = F.lit("2024-01-03 12:00:00").cast("timestamp")
    assert [r.chunk_id for r in EC.live(cache, now, 86400).collect()] == ["c2"]
    assert EC.live(cache, now, 0).count() == 2 and EC.expired(cache, now, 86400).count() == 1
    calls = BatchEmbedder(lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    assert spark.createDataFrame([("abc",)], "t string").select(calls.column(F.col("t"))).first()[0] == [3.0, 1.0]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert with_retry(flaky, 3, 0.0) == "ok"


def test_assistant(spark, make_graph):
    n, e = make_graph({"a": "function", "b": "function", "c": "class"}, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "contains")])
    emb = MockEmbedder(32)
    docs = n.select("id", "name", "qualified_name", F.col("node_type").alias("code_type"), "file_path", "line_start", "line_end",
                    F.concat(F.lit("def body "), "id").alias("content"), F.lit("python").alias("language"),
                    F.lit(None).cast("string").alias("signature"), F.lit("Doc").alias("docstring")).withColumn("embedding", emb.column(F.col("content")))
    seen = []
    generator = CachedGenerator(lambda p: seen.append(p) or "see foo_bar() and x.y", 2)
    retriever = CodeRetriever(docs, n, e, embedder=emb, settings=RetrievalSettings(semantic_threshold=0.0))
    bot = CodeAssistant(retriever, generator)
    local = bot.ask("body", "local")
    assert local.response and "## Relevant Code" in seen[0]["user"] and "--[CALLS]-->" in seen[0]["user"]
    assert sorted(local.citations) == ["m.a", "m.b", "m.c"]
    drift = bot.ask("body", "drift")
    assert drift.iterations == 2 and "## Code Communities" in seen[-1]["user"]
    assert {r.code_id for r in retriever.by_relationship("a", "siblings").collect()} == set()
    assert {r.code_id for r in retriever.by_relationship("a", "callees", 2).collect()} == {"b", "c"}
    assert bot.explain("zz") == "Code not found." and bot.explain("a")
    assert bot.summarise_file("f.py")[1].count() == 3


def test_graph_json_is_stored_compressed(spark, monkeypatch):
    nodes = spark.createDataFrame([("a", "A", "class"), ("b", "B", "class"), (None, "C", "class")], "id string, name string, node_type string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "gone", "calls"), ("a", "b", "calls")], "src string, dst string, edge_type string")
    written, export = [], GS.GraphStore.export_json
    monkeypatch.setattr(graph_queries, "graph", lambda *_: (nodes, edges))
    monkeypatch.setattr(GS.GraphStore, "export_json", lambda *a, **k: (written.append(export(*a, **k)), written[0])[1])
    rows = sorted(graph_queries.graph_json(spark, "").collect(), key=str)
    assert [(r.kind, r.a) for r in rows] == [("edge", "a>b"), ("edge", "a>b"), ("node", "a"), ("node", "b"), ("node", None)]
    parts = [n for n in GS.list_children(spark, written[0]) if n.startswith("part-")]
    assert parts and all(n.endswith(".gz") for n in parts)
