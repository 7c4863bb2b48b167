"""Text, hashing and projection queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.catalog.carriers import CALLS, DOC_UNITS, mock_vector, tok
from codegrove.catalog.registry import query
from codegrove.functions import text as T
from codegrove.functions import vectors as V
from codegrove.operators import documents as DOC
from codegrove.operators import filters as FL
from codegrove.operators import metrics as M
from codegrove.sources import tables as D
from codegrove.sources.models import MockEmbedder, embed

EXTENSIONS = [
    "py", "js", "jsx", "ts", "tsx", "java", "go", "rs", "cpp", "cc", "cxx", "c", "h", "php", "hpp", "rb", "swift",
    "kt", "scala", "cs", "PY", "txt",
]


@query(
    "tokenize", "F1 F2 F3",
    f"""SELECT doc_id, CAST(len({tok('text')}) AS INTEGER) AS tokens, md5(array_to_string({tok('text')}, ' ')) AS digest,
    CAST(len({tok('text', 2)}) AS INTEGER) AS long_tokens FROM documents""",
)
def tokenize(spark, sf):
    d = D.documents(spark, sf)
    t = T.tokens(F.col("text"))
    return d.select(
        "doc_id", F.size(t).alias("tokens"), F.md5(F.array_join(t, " ")).alias("digest"),
        F.size(T.tokens(F.col("text"), 2)).alias("long_tokens"),
    )


@query(
    "content_hashes", "F6 F7 F9 F11",
    """SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 16) AS short_hash, md5(CAST(doc_id AS VARCHAR)) AS doc_key,
    md5(source || ':' || doc_id || ':' || n_chars) AS quick FROM documents""",
)
def content_hashes(spark, sf):
    d = D.documents(spark, sf)
    return d.select(
        "doc_id", T.content_hash(F.col("text")).alias("full_hash"), T.content_hash(F.col("text"), 16).alias("short_hash"),
        T.document_key(F.col("doc_id").cast("string")).alias("doc_key"),
        T.quick_hash(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("quick"),
    )


@query(
    "mock_embedding", "F10",
    f"""WITH v AS (SELECT doc_id, {mock_vector('sha256(text)', 40)} AS e FROM documents),
    n AS (SELECT doc_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v)
    SELECT doc_id, round(e[1] / l, 6) AS first, round(e[33] / l, 6) AS wrapped, round(e[40] / l, 6) AS last, len(e) AS dims FROM n""",
)
def mock_embedding(spark, sf):
    d = D.documents(spark, sf).select("doc_id", V.mock_embedding(F.col("text"), 40).alias("e"))
    return d.select(
        "doc_id", F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.get("e", F.lit(32)), 6).alias("wrapped"),
        F.round(F.get("e", F.lit(39)), 6).alias("last"), F.size("e").cast("bigint").alias("dims"),
    )


@query(
    "token_totals", "F12 F13 A19 T14",
    r"""SELECT lang, count(*) AS texts, CAST(sum(len(list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> ''))) AS BIGINT) AS total_tokens,
    CAST(sum(length(text) // 4) AS BIGINT) AS estimate FROM documents GROUP BY lang""",
)
def token_totals(spark, sf):
    d = embed(D.documents(spark, sf), F.col("text"), MockEmbedder(32))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("token_count").alias("total_tokens"),
        F.sum(T.token_estimate(F.col("text"))).alias("estimate"),
    )


def _case(table: dict[str, str]) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())


@query(
    "file_languages", "S5 S6",
    f"""WITH p AS (SELECT p_partkey, p_name || '.' || {EXTENSIONS!r}[p_size % {len(EXTENSIONS)} + 1] AS path FROM part),
    e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS x FROM p)
    SELECT p_partkey, CASE x {_case(T.PARSE_LANGUAGES)} END AS parsed_as, CASE x {_case(T.LISTING_LANGUAGES)} ELSE 'unknown' END AS listed_as FROM e""",
)
def file_languages(spark, sf):
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("p_size") % len(EXTENSIONS))
    path = F.concat_ws(".", "p_name", ext)
    return D.table(spark, sf, "part").select(
        "p_partkey", T.parse_language(path).alias("parsed_as"), T.listing_language(path).alias("listed_as")
    )


@query(
    "line_metrics", "A15 F28",
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))) AS r FROM documents)
    SELECT doc_id, CAST(len(list_filter(r, lambda x: x <> '' AND NOT starts_with(x, '#'))) AS INTEGER) AS lines_of_code,
    CAST(len(list_filter(r, lambda x: starts_with(x, '#'))) AS INTEGER) AS comment_lines,
    CAST(len(list_filter(r, lambda x: x = '')) AS INTEGER) AS blank_lines, CAST(len(r) AS INTEGER) AS all_lines FROM l""",
)
def line_metrics(spark, sf):
    d = D.documents(spark, sf)
    total = T.line_count(F.lit(1), F.size(T.lines(F.col("text"))))
    return d.select("doc_id", *M.line_counts(F.col("text")), total.alias("all_lines"))


@query(
    "code_metrics", "A15",
    f"""WITH {CALLS}, i AS (SELECT dst AS id, count(DISTINCT src) AS n FROM calls GROUP BY 1), o AS (SELECT src AS id, count(DISTINCT dst) AS n FROM calls GROUP BY 1),
    u AS (SELECT 'part:' || p_partkey AS id, p_size FROM part),
    m AS (SELECT id, CAST(p_size + 1 AS INTEGER) AS lines_of_code, 1 AS comment_lines, 1 AS blank_lines, coalesce(i.n, 0) AS dependencies_in, coalesce(o.n, 0) AS dependencies_out
      FROM u LEFT JOIN i USING (id) LEFT JOIN o USING (id))
    SELECT *, array_to_string(list_filter([CASE WHEN lines_of_code > 50 THEN 'Consider breaking this into smaller functions' END,
      CASE WHEN dependencies_out > 10 THEN 'High number of dependencies - consider simplifying' END,
      CASE WHEN dependencies_in > 20 THEN 'Many dependents - changes here have wide impact' END], lambda x: x IS NOT NULL), '|') AS suggestions FROM m""",
)
def code_metrics(spark, sf):
    p = D.table(spark, sf, "part")
    body = F.concat(F.lit("def f():\n  # c\n\n"), F.array_join(F.array_repeat(F.lit(" x = 1"), F.col("p_size")), "\n"))
    units = p.select(
        F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("file_path"), body.alias("content"),
    )
    rows = M.code_metrics(units, D.order_edges(spark, sf))
    return rows.select(
        "id", "lines_of_code", "comment_lines", "blank_lines", "dependencies_in", "dependencies_out",
        F.array_join("suggestions", "|").alias("suggestions"),
    )


@query(
    "context_headers", "F15 F16 F17 F18",
    f"""WITH {DOC_UNITS}, h AS (SELECT id, content, docstring, signature,
      '# File: ' || file_path || chr(10) || '# ' || code_type || ': ' || qualified_name || chr(10) || '# Signature: ' || signature
        || CASE WHEN trim(docstring) <> '' THEN chr(10) || '# ' || trim(docstring) ELSE '' END AS head,
      'Signature: ' || signature || ' | Name: ' || qualified_name || ' | Type: ' || code_type
        || CASE WHEN docstring <> '' THEN ' | Doc: ' || docstring ELSE '' END AS line FROM doc_units)
    SELECT id, md5(head) AS head, md5(line) AS line, md5(head || chr(10) || chr(10) || content) AS embedded,
    md5(signature || CASE WHEN docstring <> '' THEN ' ' || docstring ELSE '' END || ' ' || content) AS unit_text FROM h""",
)
def context_headers(spark, sf):
    c = F.col
    head = T.file_header(c("file_path"), c("code_type"), c("qualified_name"), c("signature"), c("docstring"))
    line = T.inline_header(c("signature"), c("qualified_name"), c("code_type"), c("docstring"))
    return D.document_units(spark, sf).select(
        "id", F.md5(head).alias("head"), F.md5(line).alias("line"),
        F.md5(T.embedding_text(head, c("content"), F.lit(None).cast("string"))).alias("embedded"),
        F.md5(T.unit_embedding_text(c("signature"), c("docstring"), c("content"))).alias("unit_text"),
    )


def _as_units(spark, sf):
    return D.document_units(spark, sf).withColumnRenamed("code_type", "type").withColumns(
        {"decorators": F.array(), "base_classes": F.array(), "parent_id": F.lit(None).cast("string")}
    )


@query(
    "index_documents", "P25 F11 F31",
    f"""WITH {DOC_UNITS} SELECT id, md5(id) AS doc_key, code_type, md5(content) AS content,
    signature, md5(docstring) AS docstring FROM doc_units""",
)
def index_documents(spark, sf):
    return DOC.documents_of(_as_units(spark, sf)).select(
        "id", "doc_key", "code_type", F.md5("content").alias("content"), "signature", F.md5("docstring").alias("docstring")
    )


@query(
    "hit_defaults", "P24",
    """SELECT CAST(d.doc_id AS VARCHAR) AS id, '' AS name, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, '') AS code_type, coalesce(l.toxic, 0) AS line_start
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def hit_defaults(spark, sf):
    rows = D.documents(spark, sf).join(D.table(spark, sf, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    raw = rows.select(
        F.col("doc_id").cast("string").alias("id"), none.alias("name"), none.alias("qualified_name"),
        F.when(F.col("quality") == 1, "good").alias("code_type"), none.alias("file_path"), none.alias("content"),
        none.alias("language"), F.col("toxic").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        F.lit(None).cast("double").alias("score"),
    )
    return DOC.hit_defaults(raw).select("id", "name", "code_type", "line_start")


@query(
    "graph_to_documents", "S35",
    """SELECT 'n' || doc_id AS id, md5('n' || doc_id) AS doc_key, md5(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))) AS content,
    'd/' || doc_id || '.py' AS file_path, 'python' AS language FROM documents""",
)
def graph_to_documents(spark, sf):
    d = D.documents(spark, sf)
    path = F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".py"))
    files = d.select(path.alias("file_path"), F.col("text").alias("content"))
    nodes = d.select(
        F.concat(F.lit("n"), F.col("doc_id")).alias("id"), F.col("lang").alias("name"), F.col("source").alias("qualified_name"),
        F.lit("function").alias("node_type"), path.alias("file_path"), F.lit(2).alias("line_start"), F.lit(4).alias("line_end"),
    )
    return DOC.documents_from_graph(nodes, files).select(
        "id", "doc_key", F.md5("content").alias("content"), "file_path", "language"
    )


@query(
    "field_distribution", "A11",
    """WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), f AS (
    SELECT 'doc_id' AS field, count(doc_id) AS documents FROM j UNION ALL SELECT 'text', count(text) FROM j UNION ALL SELECT 'lang', count(lang) FROM j
    UNION ALL SELECT 'source', count(source) FROM j UNION ALL SELECT 'n_chars', count(n_chars) FROM j
    UNION ALL SELECT 'quality', count(quality) FROM j UNION ALL SELECT 'toxic', count(toxic) FROM j)
    SELECT (SELECT count(*) FROM j) AS total_documents, * FROM f""",
)
def field_distribution(spark, sf):
    rows = D.documents(spark, sf).join(D.table(spark, sf, "labels"), "doc_id", "left")
    return M.field_distribution(rows)


@query(
    "path_predicates", "P17 P27 P28",
    r"""SELECT page_id, regexp_full_match(url, 'https://.*/en/.*') AS listed,
    (contains(url, 'example.net') OR contains(url, '#top')) AS skipped,
    NOT contains(url, '.org') AND regexp_matches(url, '(^|/)[0-9][^/]*$') AS watched FROM pages""",
)
def path_predicates(spark, sf):
    url = F.col("url")
    return D.table(spark, sf, "pages").select(
        "page_id", FL.any_glob(url, ["https://*/en/*"]).alias("listed"),
        T.mentions_any(url, ["example.net", "#top"]).alias("skipped"),
        FL.watched(url, ["[0-9]*"], [".org"]).alias("watched"),
    )
