"""Prompt texts and retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.catalog.carriers import CALLS, DOC_UNITS, NODES
from codegrove.catalog.registry import query
from codegrove.functions import prompts as P
from codegrove.operators import components as C
from codegrove.operators import graph_lookup as L
from codegrove.plans import prompting
from codegrove.plans.retrieval import CodeAssistant, CodeRetriever, RetrievalSettings
from codegrove.sources import tables as D
from codegrove.sources.models import MockEmbedder
from codegrove.staging import Stage

_CTX_TEXT = """'[' || upper(code_type) || '] ' || qualified_name || chr(10) || '  File: ' || file_path || ':' || line_start || '-' || line_end || chr(10) || '  Language: ' || language
  || CASE WHEN docstring <> '' THEN chr(10) || '  Doc: ' || docstring ELSE '' END
  || chr(10) || '  Code:' || chr(10) || array_to_string(list_transform(string_split(content, chr(10)), lambda s: '    ' || s), chr(10))"""


@query("context_texts", "F19", f"WITH {DOC_UNITS} SELECT id, md5({_CTX_TEXT}) AS body FROM doc_units")
def context_texts(spark, sf):
    return D.document_units(spark, sf).select("id", F.md5(P.context_text()).alias("body"))


@query(
    "code_explanations", "F23",
    f"""WITH {DOC_UNITS} SELECT id, md5('**' || name || '** (' || code_type || ')' || chr(10) || 'Location: ' || language || ':' || line_start || '-' || line_end
    || CASE WHEN docstring <> '' THEN chr(10) || 'Description: ' || docstring ELSE '' END) AS body FROM doc_units""",
)
def code_explanations(spark, sf):
    return D.document_units(spark, sf).select("id", F.md5(P.code_explanation()).alias("body"))


@query(
    "relationship_texts", "F20 F22",
    f"""WITH {CALLS} SELECT src, dst, src || ' --[CALLS]--> ' || dst || chr(10) || '  (' || src || ' calls ' || dst || ')' AS shown, src || ' calls ' || dst AS explained FROM calls""",
)
def relationship_texts(spark, sf):
    e = L.edges_of_type(D.order_edges(spark, sf), "calls")
    path = F.array(F.struct(F.col("dst").alias("node"), F.lit("CALLS").alias("edge_type")))
    s, d = F.col("src"), F.col("dst")
    return e.select(
        "src", "dst", P.relationship_text(s, d, path, F.concat_ws(" calls ", s, d)).alias("shown"),
        P.path_explanation(s, d, path).alias("explained"),
    )


@query(
    "community_texts", "F21 A13",
    """WITH t AS (SELECT conv_id, conv_id || ':' || turn AS id, role || '_' || turn AS name, role FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS rn FROM t), m AS (SELECT conv_id, role, count(*) AS n, min(rn) AS a FROM r WHERE rn <= 50 GROUP BY ALL),
    b AS (SELECT conv_id, arg_max(role, (n, -a)) AS role FROM m GROUP BY 1)
    SELECT '[COMMUNITY] Community ' || min(id) || ' (' || count(*) || ' components)' || chr(10) || '  Primarily contains ' || b.role || 's across 1 file(s)' || chr(10) || '  Key: '
    || array_to_string(list(r.name ORDER BY rn) FILTER (rn <= 5), ', ') AS body FROM r JOIN b USING (conv_id) GROUP BY conv_id, b.role""",
)
def community_texts(spark, sf):
    nodes = D.turn_nodes(spark, sf)
    members = Stage(spark, "members").table(C.weak_components(nodes, D.turn_edges(spark, sf)))
    s = C.community_summary(members, nodes)
    return s.select(P.community_text(F.col("name"), F.col("size"), F.col("description"), F.col("key_components")).alias("body"))


@query(
    "impact_texts", "F24",
    f"""WITH {CALLS}, {NODES}, d AS (SELECT c.dst AS id, n.name, c.src, row_number() OVER (PARTITION BY c.dst ORDER BY c.src) AS rn FROM calls c JOIN nodes n ON n.id = c.src),
    g AS (SELECT id, count(*) AS n, array_to_string(list(name ORDER BY rn) FILTER (rn <= 5), ', ') AS names FROM d GROUP BY id)
    SELECT id, 'Changing X may affect:' || chr(10) || '  Direct dependents (' || n || '): ' || names || CASE WHEN n > 5 THEN chr(10) || '    ... and ' || (n - 5) || ' more' ELSE '' END AS body FROM g""",
)
def impact_texts(spark, sf):
    calls = L.edges_of_type(D.order_edges(spark, sf), "calls")
    named = calls.join(D.order_nodes(spark, sf).select(F.col("id").alias("src"), "name"), "src")
    w = Window.partitionBy("dst").orderBy("src")
    first = named.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").groupBy("dst").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda s: s["name"]).alias("names")
    )
    counts = calls.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    body = P.impact_explanation("X", F.col("names"), F.col("n"), F.array(), F.lit(0))
    return counts.join(first, "dst").select(F.col("dst").alias("id"), body.alias("body"))


@query(
    "refined_queries", "F25",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
    c AS (SELECT doc_id, list_transform(list_filter(ws, lambda x: regexp_matches(x, '[_().]') AND length(x) > 2), lambda x: trim(x, '.,()[]{}:;')) AS t FROM w)
    SELECT doc_id, CASE WHEN len(t) > 0 THEN 'question ' || array_to_string(t, ' ') ELSE 'question' END AS refined FROM c""",
)
def refined_queries(spark, sf):
    return D.documents(spark, sf).select("doc_id", P.refined_query(F.lit("question"), F.col("text")).alias("refined"))


def _turn_items(spark, sf):
    """The turns of each conversation as prompt contexts, longest first."""
    c = D.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn", "text")
    return c.withColumn("pos", F.row_number().over(w)).select("conv_id", F.lit("contexts").alias("kind"), "pos", F.col("text").alias("body"))


_ITEMS = """it AS (SELECT conv_id, text AS body, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, text) AS pos FROM conversations),
  run AS (SELECT *, sum(length(body)) OVER (PARTITION BY conv_id ORDER BY pos) AS total FROM it),
  kept AS (SELECT * FROM run WHERE pos = 1 OR (total + 12) // 4 <= 300)"""


@query("prompt_budget", "G8 F13 T29", f"WITH {_ITEMS} SELECT conv_id, CAST(pos AS INTEGER) AS pos, md5(body) AS body FROM kept")
def prompt_budget(spark, sf):
    rows = prompting.within_budget(_turn_items(spark, sf), 12, 300, ["conv_id"])
    return rows.select("conv_id", "pos", F.md5("body").alias("body"))


@query(
    "prompt_tokens", "F13",
    "SELECT conv_id, CAST((sum(length(text)) + 12) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
)
def prompt_tokens(spark, sf):
    return prompting.estimated_tokens(_turn_items(spark, sf), "What is this", ["conv_id"])


@query(
    "user_prompts", "R15 G9",
    f"""WITH {_ITEMS} SELECT conv_id, md5(chr(10) || '## Relevant Code' || chr(10) || chr(10) || array_to_string(list(body ORDER BY pos), chr(10) || chr(10)) || chr(10) || chr(10) || chr(10)
      || '## Question' || chr(10) || chr(10) || 'What is this' || chr(10) || chr(10) || 'Answer only from what is shown above.' || chr(10)) AS prompt FROM kept GROUP BY conv_id""",
)
def user_prompts(spark, sf):
    rows = prompting.within_budget(_turn_items(spark, sf), 12, 300, ["conv_id"])
    prompts = prompting.user_prompt(rows, "What is this", "local", group=["conv_id"])
    return prompts.select("conv_id", F.md5("user").alias("prompt"))


def retriever(spark, sf) -> CodeRetriever:
    """Documents as code; each document calls the one numbered after it."""
    embedder = MockEmbedder(64)
    stage = Stage(spark, "assistant")
    docs = D.document_units(spark, sf)
    ids = D.documents(spark, sf).select("doc_id")
    linked = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi")
    calls = linked.select(
        F.col("doc_id").cast("string").alias("src"), (F.col("doc_id") + 1).cast("string").alias("dst"),
        F.lit("calls").alias("edge_type"),
    )
    nodes = docs.select("id", "name", "qualified_name", F.col("code_type").alias("node_type"), "file_path", "line_start", "line_end")
    # a stored index: vectors are computed once, not per question
    indexed = stage.table(docs.withColumn("embedding", embedder.column(F.col("content"))))
    return CodeRetriever(indexed, stage.table(nodes), stage.table(calls), embedder=embedder, settings=RetrievalSettings(semantic_threshold=0.3))


@query("retrieve_local", "G1 G2 G5 G12 J20 T10 F32")
def retrieve_local(spark, sf):
    found = retriever(spark, sf).retrieve("function the and", "local")
    ctx = found.contexts.select(F.lit("context").alias("kind"), F.col("code_id").alias("a"), F.col("qualified_name").alias("b"))
    return ctx.unionByName(found.relationships.select(F.lit("relationship").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("answer_drift", "G3 G5 G6 G9 U5 U6 T28 I25 S33 S34 G14")
def answer_drift(spark, sf):
    answer = CodeAssistant(retriever(spark, sf)).ask("class der die", "drift")
    return answer.retrieval.contexts.select(
        "code_id", F.round("relevance_score", 6).alias("score"), F.lit(answer.iterations).alias("iterations"), F.lit(answer.response).alias("response")
    )


@query(
    "answer_prompt_sections", "G10",
    f"""WITH {DOC_UNITS} SELECT file_path, id, count(*) OVER (PARTITION BY file_path) AS total_components,
      CAST(row_number() OVER (PARTITION BY file_path ORDER BY id) AS INTEGER) AS pos, md5(name || chr(10) || content) AS shown FROM doc_units""",
)
def answer_prompt_sections(spark, sf):
    """G10 for every file at once: all its units in their order, one row each, and how many the file has."""
    docs = D.document_units(spark, sf)
    own = Window.partitionBy("file_path")
    return docs.select(
        "file_path", "id", F.count(F.lit(1)).over(own).alias("total_components"), F.row_number().over(own.orderBy("id")).alias("pos"),
        F.md5(F.concat_ws("\n", "name", "content")).alias("shown"),
    )
