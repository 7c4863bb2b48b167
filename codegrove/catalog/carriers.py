"""SQL forms of the carriers in ``sources/tables.py``, for the oracle side."""

from __future__ import annotations


def tok(x: str, min_length: int = 1) -> str:
    """Identifier tokens of a text expression."""
    return (
        "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace("
        rf"{x}, '[^a-zA-Z0-9]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), "
        rf"'([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), ' +'), lambda w: len(w) >= {min_length})"
    )


def byte_at(digest: str, i: str) -> str:
    """Value of the i-th byte of a hex digest, scaled to [-1, 1]."""
    hexa = "'0123456789abcdef'"
    hi = f"(strpos({hexa}, substr({digest}, CAST(({i} % 32) * 2 + 1 AS BIGINT), 1)) - 1)"
    lo = f"(strpos({hexa}, substr({digest}, CAST(({i} % 32) * 2 + 2 AS BIGINT), 1)) - 1)"
    return f"(({hi} * 16 + {lo}) / 255.0::DOUBLE * 2.0 - 1.0)"


def mock_vector(digest: str, dims: int) -> str:
    return f"list_transform(range(0, {dims}), lambda i: {byte_at(digest, 'i')})"


DOC_UNITS = """doc_units AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'doc_' || doc_id AS name, source || '.doc_' || doc_id AS qualified_name,
    CASE lang WHEN 'en' THEN 'function' WHEN 'de' THEN 'class' WHEN 'fr' THEN 'method' ELSE 'module' END AS code_type,
    source || '/' || lang AS file_path, 1 AS line_start, len(string_split(text, chr(10))) AS line_end,
    text AS content, lang AS language, lang || '(' || n_chars || ')' AS signature,
    string_split(text, chr(10))[1] AS docstring
  FROM documents)"""

SYMBOLS = """symbols AS (
  SELECT 'part:' || p_partkey AS id, replace(p_name, ' ', '_') AS name,
    p_brand || '.' || replace(p_name, ' ', '_') AS qualified_name, lower(p_type) AS code_type,
    p_brand AS language,
    lower(p_brand) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.py' AS file_path,
    p_size AS line_start, p_size + 9 AS line_end, p_partkey AS seq
  FROM part)"""

NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region.' || r_name AS qualified_name, 'module' AS node_type, 'regions.py' AS file_path FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation.' || n_name, 'class', 'nations.py' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer.' || c_name, 'class', 'customers/' || c_nationkey || '.py' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier.' || s_name, 'function', 'suppliers/' || s_nationkey || '.py' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part.' || p_name, 'function', 'parts/' || lower(p_brand) || '.py' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, o_orderpriority, 'orders.' || o_orderpriority, 'method', 'orders/' || year(o_orderdate) || '.py' FROM orders)"""

CALLS = """calls AS (
  SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem)"""

CONTAINS = """contain AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""

INHERITS = """inherit AS (
  SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""

EDGES = f"""{CALLS}, {CONTAINS}, {INHERITS}, edges AS (
  SELECT src, dst, 'calls' AS edge_type FROM calls
  UNION ALL SELECT dst, src, 'called_by' FROM calls
  UNION ALL SELECT src, dst, 'contains' FROM contain
  UNION ALL SELECT dst, src, 'contained_by' FROM contain
  UNION ALL SELECT src, dst, 'inherits' FROM inherit
  UNION ALL SELECT dst, src, 'inherited_by' FROM inherit
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports' FROM supplier)"""

TRANSITIONS = """steps AS (
  SELECT event_type || '@' || CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS src,
    lead(event_type || '@' || CAST(floor((day(ts) - 1) / 7) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst
  FROM events),
trans AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
states AS (SELECT DISTINCT src AS id FROM trans UNION SELECT DISTINCT dst FROM trans)"""
