"""Chunking and embedding-cache queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.catalog.carriers import DOC_UNITS
from codegrove.catalog.registry import query
from codegrove.functions import text as T
from codegrove.operators import chunking as K
from codegrove.operators import embedding_cache as EC
from codegrove.sources import tables as D
from codegrove.sources.models import MockEmbedder


def document_code_units(spark, sf):
    return D.document_units(spark, sf).withColumnRenamed("code_type", "type")


def _ranges_sql(maximum: int, overlap: int) -> str:
    """Greedy line ranges as a recursive query: each step jumps to the next chunk."""
    return f"""
    u AS (SELECT id, content, list_transform(string_split(content, chr(10)), lambda s: length(s)) AS ln FROM doc_units WHERE length(content) > {maximum}),
    e AS (SELECT id, len(ln) AS n, list_prepend(0, list_transform(range(1, len(ln) + 1), lambda k: CAST(list_sum(list_slice(ln, 1, k)) + k AS BIGINT))) AS ends FROM u),
    w AS (
      SELECT id, n, ends, CAST(0 AS BIGINT) AS first, greatest(len(list_filter(ends, lambda x: x <= {maximum})) - 1, 1) AS stop, 0 AS idx FROM e
      UNION ALL
      SELECT id, n, ends, carry, greatest(len(list_filter(ends, lambda x: x <= ends[carry + 1] + {maximum})) - 1, stop + 1), idx + 1
      FROM (SELECT *, greatest(first, stop - len(list_filter(list_slice(ends, first + 1, stop), lambda x: ends[stop + 1] - x <= {overlap}))) AS carry FROM w WHERE stop < n)),
    r AS (SELECT w.id, idx, first, stop, ends[stop + 1] - ends[first + 1] - 1 AS size, stop = n AS is_last,
      array_to_string(list_slice(string_split(content, chr(10)), first + 1, stop), chr(10)) AS body FROM w JOIN u USING (id))"""


@query(
    "chunk_lines", "K1 K2 K3 T23",
    f"""WITH RECURSIVE {DOC_UNITS}, {_ranges_sql(6000, 200)},
    k AS (SELECT id, body, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM (
      SELECT *, count(*) FILTER (size >= 100) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
      WHERE size >= 100 OR (is_last AND coalesce(before, 0) = 0))
    SELECT id || '::0' AS id, id AS unit_id, md5(content) AS content, 0 AS chunk_index, 1 AS total_chunks FROM doc_units WHERE length(content) <= 6000
    UNION ALL SELECT id || '::' || i, id, md5(body), CAST(i AS INTEGER), CAST(n AS INTEGER) FROM k""",
)
def chunk_lines(spark, sf):
    rows = K.chunk_for_parsing(document_code_units(spark, sf))
    return rows.select("id", "unit_id", F.md5("content").alias("content"), "chunk_index", "total_chunks")


@query("chunk_smart", "K4 K5 K2")
def chunk_smart(spark, sf):
    rows = K.chunk_smart(document_code_units(spark, sf))
    return rows.select("id", "unit_id", F.md5("content").alias("content"), "chunk_index", "total_chunks")


_EMBED_CHUNKS = f"""{_ranges_sql(2000, 200)},
    j AS (SELECT *, lead(body) OVER (PARTITION BY id ORDER BY idx) AS nbody, lead(size) OVER (PARTITION BY id ORDER BY idx) AS nsize,
      lead(is_last) OVER (PARTITION BY id ORDER BY idx) AS nlast FROM r),
    m AS (SELECT id, idx, first + 1 AS start_line,
      CASE WHEN is_last OR (nlast AND nsize < 100) THEN NULL ELSE stop END AS stop_line,
      body || CASE WHEN nlast AND nsize < 100 THEN chr(10) || nbody ELSE '' END AS body FROM j WHERE NOT (is_last AND size < 100 AND idx > 0)),
    chunks AS (SELECT id || '::chunk_0' AS chunk_id, id AS unit_id, content, line_start AS start_line, line_end AS end_line, name, code_type, file_path FROM doc_units WHERE length(content) <= 2000
      UNION ALL SELECT m.id || '::chunk_' || idx, m.id, body, CAST(start_line AS INTEGER), coalesce(stop_line, line_end), name, code_type, file_path FROM m JOIN doc_units USING (id))"""


@query(
    "chunk_embedding", "K6 K7 F16 T23",
    f"""WITH RECURSIVE {DOC_UNITS}, {_EMBED_CHUNKS}
    SELECT chunk_id AS id, unit_id, substr(sha256(content), 1, 16) AS content_hash, start_line, CAST(end_line AS INTEGER) AS end_line, length(content) AS size, name FROM chunks""",
)
def chunk_embedding(spark, sf):
    rows = K.chunk_for_embedding(document_code_units(spark, sf))
    return rows.select(
        "id", "unit_id", "content_hash", "start_line", "end_line", F.length("content").cast("bigint").alias("size"),
        F.col("metadata")["name"].alias("name"),
    )


def _cache_of_labelled(spark, sf):
    """Cache rows of the labelled documents, keyed by whole-text hash."""
    d = D.documents(spark, sf).join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.select(
        T.content_hash(F.col("text"), 16).alias("content_hash"), F.col("doc_id").cast("string").alias("unit_id")
    )


def _probes(spark, sf):
    return D.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), T.content_hash(F.col("text"), 16).alias("content_hash")
    )


_H = "substr(sha256(text), 1, 16)"
_CACHED = f"cached AS (SELECT DISTINCT {_H} AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


@query("cache_missing", "J17 U8", f"WITH {_CACHED} SELECT CAST(doc_id AS VARCHAR) AS id, {_H} AS content_hash FROM documents WHERE {_H} NOT IN (SELECT h FROM cached)")
def cache_missing(spark, sf):
    return EC.missing(_probes(spark, sf), _cache_of_labelled(spark, sf)).select("id", "content_hash")


@query(
    "cache_lookup", "J18",
    f"""SELECT {_H} AS content_hash, CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    AND {_H} IN (SELECT {_H} FROM documents WHERE lang = 'en')""",
)
def cache_lookup(spark, sf):
    d = D.documents(spark, sf).filter("lang = 'en'")
    wanted = d.select(T.content_hash(F.col("text"), 16).alias("content_hash"))
    return EC.lookup(_cache_of_labelled(spark, sf), wanted).select("content_hash", "unit_id")


@query(
    "cache_of_units", "I22",
    f"""SELECT {_H} AS content_hash, CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def cache_of_units(spark, sf):
    toxic = D.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("unit_id"))
    return EC.of_units(_cache_of_labelled(spark, sf), toxic).select("content_hash", "unit_id")


@query(
    "cache_stats", "A12 J17",
    f"""WITH {_CACHED}, p AS (SELECT {_H} IN (SELECT h FROM cached) AS hit FROM documents)
    SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, (SELECT count(*) FROM cached) AS entries,
    round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS hit_rate FROM p""",
)
def cache_stats(spark, sf):
    row = EC.probe_stats(_cache_of_labelled(spark, sf), _probes(spark, sf))
    return row.withColumn("hit_rate", F.round("hit_rate", 6))


def _event_cache(spark, sf):
    ev = D.table(spark, sf, "events")
    return ev.select(
        F.md5(F.concat_ws(":", "user_id", "event_type")).alias("content_hash"),
        F.col("event_id").cast("string").alias("chunk_id"), F.col("user_id").cast("string").alias("unit_id"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("accessed_at"),
    )


_NOW = "2024-01-25 12:00:00"


@query(
    "cache_ttl", "I19 I21 F29",
    f"""SELECT CAST(event_id AS VARCHAR) AS chunk_id, CASE WHEN epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts) <= 864000 * 1000000::BIGINT THEN 'live' ELSE 'expired' END AS state FROM events""",
)
def cache_ttl(spark, sf):
    cache, now = _event_cache(spark, sf), F.lit(_NOW).cast("timestamp")
    live = EC.live(cache, now, 864000).select("chunk_id", F.lit("live").alias("state"))
    return live.unionByName(EC.expired(cache, now, 864000).select("chunk_id", F.lit("expired").alias("state")))


@query(
    "cache_put", "I20 I7",
    """SELECT md5(user_id || ':' || event_type) AS content_hash, arg_max(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS chunk_id FROM events GROUP BY 1""",
)
def cache_put(spark, sf):
    rows = _event_cache(spark, sf)
    old = rows.filter(F.col("created_at") < F.lit("2024-01-10").cast("timestamp"))
    first = EC.put(rows.limit(0), old)
    return EC.put(first, rows).select("content_hash", "chunk_id")


@query(
    "cache_drop_units", "I21",
    """SELECT CAST(event_id AS VARCHAR) AS chunk_id, CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-01-25 12:00:00' ELSE ts END AS accessed_at FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)""",
)
def cache_drop_units(spark, sf):
    ev = D.table(spark, sf, "events")
    gone = ev.filter("event_type = 'error' and value > 150").select(F.col("user_id").cast("string").alias("unit_id"))
    used = ev.filter("event_type = 'view'").select(F.md5(F.concat_ws(":", "user_id", "event_type")).alias("content_hash"))
    rows = EC.touch(EC.drop_units(_event_cache(spark, sf), gone), used, F.lit(_NOW).cast("timestamp"))
    return rows.select("chunk_id", F.col("accessed_at").cast("timestamp_ntz").alias("accessed_at"))


@query(
    "embed_pipeline", "G18 J17 S32 F7 A19 T14",
    rf"""WITH RECURSIVE {DOC_UNITS}, {_EMBED_CHUNKS}, known AS (SELECT DISTINCT substr(sha256(text), 1, 16) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    t AS (SELECT chunk_id, unit_id, substr(sha256(content), 1, 16) AS content_hash, start_line, end_line,
      'Signature: ' || signature || ' | Name: ' || qualified_name || ' | Type: ' || d.code_type || CASE WHEN docstring <> '' THEN ' | Doc: ' || docstring ELSE '' END || chr(10) || chr(10) || c.content AS full_text
      FROM chunks c JOIN (SELECT id, signature, qualified_name, code_type, docstring FROM doc_units) d ON d.id = c.unit_id)
    SELECT chunk_id, unit_id, content_hash, CAST(start_line AS VARCHAR) AS start_line, CAST(end_line AS VARCHAR) AS end_line,
      CAST(len(list_filter(string_split_regex(full_text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS VARCHAR) AS token_count,
      strpos('0123456789abcdef', substr(sha256(full_text), 1, 1)) > 8 AS first_positive FROM t WHERE content_hash NOT IN (SELECT h FROM known)""",
)
def embed_pipeline(spark, sf):
    chunks = K.chunk_for_embedding(document_code_units(spark, sf))
    rows = EC.embed_chunks(chunks, _cache_of_labelled(spark, sf), MockEmbedder(64), F.lit(_NOW).cast("timestamp"))
    meta = F.col("metadata")
    return rows.select(
        "chunk_id", "unit_id", "content_hash", meta["start_line"].alias("start_line"), meta["end_line"].alias("end_line"),
        meta["token_count"].alias("token_count"), (F.get("embedding", F.lit(0)) > 0).alias("first_positive"),
    )
