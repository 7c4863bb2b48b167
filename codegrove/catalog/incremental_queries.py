"""Snapshots, upserts, tasks and streaming.

The change stream is ``events``: a path per user, ``signup`` creates, ``error`` deletes, the rest modifies.
Two snapshots are the states of all paths at two moments of that stream.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codegrove.catalog.carriers import DOC_UNITS
from codegrove.catalog.registry import query
from codegrove.functions import text as T
from codegrove.operators import metrics as M
from codegrove.operators import sketches as K
from codegrove.operators import snapshots as N
from codegrove.sources import tables as D
from codegrove.sources import graph_store as GS
from codegrove.sources.index_store import DocumentIndex
from codegrove.staging import Stage
from codegrove.streaming import changes as C
from codegrove.streaming import watch as W

_EARLY, _LATE = "2024-01-04 00:00:00", "2024-01-20 00:00:00"


def changes(spark, sf):
    ev = D.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    path = F.concat(F.lit("src/u"), F.col("user_id"), F.when(F.col("value") > 50, ".txt").otherwise(".py"))
    return ev.select(path.alias("path"), kind.alias("change_type"), "ts", "event_id", F.col("props").alias("content"))


def snapshot(spark, sf, at: str):
    rows = changes(spark, sf).filter(F.col("ts") < F.lit(at).cast("timestamp_ntz"))
    last = N.latest_changes(rows, F.struct("ts", "event_id")).filter("change_type <> 'deleted'")
    return last.select(F.col("path").alias("file_path"), F.md5("content").alias("content_hash"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"))


_CHANGES = """ch AS (SELECT 'src/u' || user_id || CASE WHEN value > 50 THEN '.txt' ELSE '.py' END AS path,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, ts, event_id, props AS content FROM events)"""


def _snap(name: str, at: str) -> str:
    return f"""{name} AS (SELECT path AS file_path, md5(content) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn
      FROM ch WHERE ts < TIMESTAMP '{at}') WHERE rn = 1 AND change_type <> 'deleted')"""


_BOTH = f"""{_CHANGES}, {_snap('a', _EARLY)}, {_snap('b', _LATE)}, diff AS (SELECT coalesce(a.file_path, b.file_path) AS file_path,
  CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'deleted' WHEN a.content_hash <> b.content_hash THEN 'modified' ELSE 'unchanged' END AS status
  FROM a FULL OUTER JOIN b ON a.file_path = b.file_path)"""


@query("snapshot_diff", "J16 U1 S25", f"WITH {_BOTH} SELECT file_path, status FROM diff")
def snapshot_diff(spark, sf):
    """The earlier snapshot is saved as the state of a run and read again, as the next run does."""
    state = f"{Stage(spark, 'state').base}/files"
    GS.save_state(snapshot(spark, sf, _EARLY).withColumn("mtime", F.col("mtime") / 1e6), state)
    return N.compare(GS.load_state(spark, state), snapshot(spark, sf, _LATE))


@query(
    "update_plan", "I5 I7 I8",
    f"WITH {_BOTH} SELECT file_path, status, CASE status WHEN 'deleted' THEN 'remove' ELSE 'index' END AS action FROM diff WHERE status <> 'unchanged'",
)
def update_plan(spark, sf):
    return N.update_plan(N.compare(snapshot(spark, sf, _EARLY), snapshot(spark, sf, _LATE)))


@query(
    "watch_events", "U2 I2",
    f"""WITH {_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM ch WHERE ts < TIMESTAMP '{_EARLY}'),
    m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM ch WHERE ts < TIMESTAMP '{_LATE}'),
    a AS (SELECT path, ts FROM l WHERE rn = 1 AND change_type <> 'deleted'), b AS (SELECT path, ts FROM m WHERE rn = 1 AND change_type <> 'deleted')
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
    FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.ts IS DISTINCT FROM b.ts""",
)
def watch_events(spark, sf):
    rows = N.watch_events(snapshot(spark, sf, _EARLY), snapshot(spark, sf, _LATE), F.lit(_LATE).cast("timestamp"))
    return rows.select("path", "change_type")


_LATEST = f"{_CHANGES}, last AS (SELECT path, change_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM ch) WHERE rn = 1)"


@query("latest_change", "I3 P29", f"WITH {_LATEST} SELECT * FROM last")
def latest_change(spark, sf):
    return N.latest_changes(changes(spark, sf), F.struct("ts", "event_id")).select("path", "change_type", "event_id")


@query(
    "changes_to_actions", "I6 P27 P29",
    f"WITH {_LATEST} SELECT path, change_type, CASE change_type WHEN 'deleted' THEN 'remove' ELSE 'index' END AS action FROM last WHERE change_type = 'deleted' OR path LIKE '%.py'",
)
def changes_to_actions(spark, sf):
    return N.planned_from_changes(N.latest_changes(changes(spark, sf), F.struct("ts", "event_id")).select("path", "change_type"))


@query("stream_latest_change", "I1 I2 I3 I4 I17 G16 T16", f"WITH {_LATEST} SELECT * FROM last")
def stream_latest_change(spark, sf):
    """The change stream through Structured Streaming: last change per batch, then over all batches."""
    schema = D.table(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", "50").parquet(sf)
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    path = F.concat(F.lit("src/u"), F.col("user_id"), F.when(F.col("value") > 50, ".txt").otherwise(".py"))
    stream = ev.select(path.alias("path"), F.col("ts").alias("timestamp"), "event_id", kind.alias("change_type"))
    base = Stage(spark, "stream").base
    W.wait(W.start(stream, W.fan_out([W.change_sink(f"{base}/changes", "timestamp")]), f"{base}/checkpoint"))
    rows = spark.read.parquet(f"{base}/changes")
    return N.latest_changes(rows, F.struct("timestamp", "event_id")).select("path", "change_type", "event_id")


_POLLS = [f"2024-01-{day:02d} 00:00:00" for day in (4, 9, 14, 19, 24)]
_POLL_GAP = timedelta(days=5)


def _polls_sql() -> str:
    """Changes from each listing to the next; before the first there is none."""
    snaps = [
        f"""s{i} AS (SELECT path, ts FROM (SELECT path, ts, change_type, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn
        FROM ch WHERE ts < TIMESTAMP '{at}') WHERE rn = 1 AND change_type <> 'deleted')"""
        for i, at in enumerate(_POLLS)
    ]
    parts = [f"SELECT path, 'created' AS change_type, TIMESTAMP '{_POLLS[0]}' AS timestamp FROM s0"]
    parts += [
        f"""SELECT coalesce(a.path, b.path), CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END, TIMESTAMP '{at}'
        FROM s{i} a FULL OUTER JOIN s{i + 1} b ON a.path = b.path WHERE a.ts IS DISTINCT FROM b.ts"""
        for i, at in enumerate(_POLLS[1:])
    ]
    return f"WITH {_CHANGES}, {', '.join(snaps)} {' UNION ALL '.join(parts)}"


@query("stream_watch_events", "I1 I2 U2", _polls_sql())
def stream_watch_events(spark, sf):
    """Listings arrive one after the other; the changes between them come out of the state of each path."""
    base = Stage(spark, "listings").base
    schema = "path string, mtime long, at timestamp"
    with C.rocks(spark):
        stream = C.detect_changes(spark.readStream.schema(schema).parquet(f"{base}/in/*"), _POLL_GAP)
        for i, at in enumerate(_POLLS):
            now = snapshot(spark, sf, at).select(F.col("file_path").alias("path"), "mtime", F.lit(at).cast("timestamp").alias("at"))
            now.write.parquet(f"{base}/in/{i}")
            C.drained(stream, f"{base}/out", f"{base}/checkpoint")
        # a later listing, of nothing that is asked for, moves the time on
        end = datetime.fromisoformat(_POLLS[-1]) + timedelta(milliseconds=1)
        spark.createDataFrame([("", 0, end)], schema).write.parquet(f"{base}/in/{len(_POLLS)}")
        C.drained(stream, f"{base}/out", f"{base}/checkpoint")
    out = spark.read.schema(C.CHANGES).parquet(f"{base}/out")
    return out.filter("path <> ''").select("path", "change_type", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query(
    "stream_sessions", "I1 I3",
    """WITH on_time AS (SELECT * FROM events WHERE event_type <> 'signup'),
    kept AS (SELECT * FROM on_time UNION ALL SELECT * FROM events WHERE event_type = 'signup' AND ts > (SELECT max(ts) - INTERVAL 2 DAY FROM on_time)),
    marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 HOUR THEN 0 ELSE 1 END AS new FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM marked)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 5 HOUR AS ended, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors
    FROM numbered GROUP BY user_id, n""",
)
def stream_sessions(spark, sf):
    """Sign-ups arrive after everything else, and every second delivery repeats the first: late and repeated events are left out."""
    base = Stage(spark, "sessions").base
    events = D.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream = C.sessions(spark.readStream.schema(events.schema).parquet(f"{base}/in/*"), "5 hours", "2 days")
    on_time = events.filter("event_type <> 'signup'")
    last = F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), last, F.lit("end").alias("event_type"))
    late = events.filter("event_type = 'signup'").unionByName(on_time)
    for i, arrived in enumerate((on_time, late, end)):
        arrived.write.parquet(f"{base}/in/{i}")
        C.drained(stream, f"{base}/out", f"{base}/checkpoint")
    out = spark.read.schema("user_id long, started timestamp, ended timestamp, events long, errors long").parquet(f"{base}/out")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")), "events", "errors")


_PROBABILITIES = [0.01, 0.5, 0.95, 0.99]


@query(
    "value_quantiles", "A9",
    f"""SELECT event_type, count(*) AS n, p, true AS in_bounds FROM events, (SELECT unnest({_PROBABILITIES})::DOUBLE AS p)
    WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-24' GROUP BY event_type, p""",
)
def value_quantiles(spark, sf):
    """Sketches of each day are stored, those of three weeks united; the exact share of values up to each quantile must be within 2 %."""
    ev = D.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    stored = Stage(spark, "quantiles").table(K.quantile_sketches(ev, ["event_type", "day"], "value"))
    weeks = F.col("day").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-23").cast("date"))
    found = K.merged_quantiles(stored.filter(weeks), ["event_type"], _PROBABILITIES)
    # one row for each type and probability meets the values of its type, which are counted where they are
    values = ev.filter(weeks).select(F.col("event_type").alias("of"), F.col("value").alias("x"))
    met = found.join(values, F.col("event_type") == F.col("of"))
    ranks = met.groupBy("event_type", "n", "p").agg(F.avg((F.col("x") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("value")).cast("double")).alias("upto"))
    return ranks.select("event_type", "n", "p", ((F.col("below") <= F.col("p") + 0.02) & (F.col("upto") >= F.col("p") - 0.02)).alias("in_bounds"))


# --- documents --------------------------------------------------------------------------------------


def _docs(spark, sf):
    return D.document_units(spark, sf).select("id", "name", "file_path", "code_type", F.md5("content").alias("content"), "language")


def _revised(spark, sf):
    """Labelled documents come back with their toxicity in the content, plus one new document per page."""
    labels = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic")
    changed = _docs(spark, sf).join(labels, "id").withColumn("content", F.concat_ws(":", "content", "toxic")).drop("toxic")
    new = D.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("url").alias("name"), F.lit("pages").alias("file_path"),
        F.lit("module").alias("code_type"), F.md5("html").alias("content"), F.lit("html").alias("language"),
    )
    return changed.unionByName(new)


_DOCS = f"""{DOC_UNITS}, old AS (SELECT id, name, file_path, code_type, md5(content) AS content, language FROM doc_units),
  rev AS (SELECT id, name, file_path, code_type, content || ':' || toxic AS content, language FROM old JOIN labels ON CAST(doc_id AS VARCHAR) = id
    UNION ALL SELECT 'p' || page_id, url, 'pages', 'module', md5(html), 'html' FROM pages),
  up AS (SELECT * FROM rev UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM rev))"""


@query("upsert_documents", "S27 I20 I28", f"WITH {_DOCS} SELECT * FROM up")
def upsert_documents(spark, sf):
    return N.upsert(_docs(spark, sf), _revised(spark, sf)).select("id", "name", "file_path", "code_type", "content", "language")


@query(
    "index_store_steps", "S26 S27 S28 S29 S30 S31 I10 K8",
    f"""WITH {_DOCS}, q AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'q' || quality AS code_type FROM labels),
    s AS (SELECT up.id, name, file_path, coalesce(q.code_type, up.code_type) AS code_type, content, language FROM up LEFT JOIN q USING (id))
    SELECT id, name, file_path, code_type, content FROM s WHERE file_path <> 'src3/en' AND language <> 'es' AND id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
)
def index_store_steps(spark, sf):
    """Add, upsert, partial update, delete by id, by file and by condition through the stored index."""
    index = DocumentIndex(spark, f"{Stage(spark, 'index').base}/docs")
    docs = _docs(spark, sf)
    index.change(upserts=docs)
    index.change(upserts=_revised(spark, sf))
    labels = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    index.update(labels.select("id", F.concat(F.lit("q"), F.col("quality")).alias("code_type")))
    index.change(deleted_ids=labels.filter("toxic = 1"), deleted_files=docs.filter("file_path = 'src3/en'").select("file_path").distinct())
    index.delete_where(F.col("language") == "es")
    index.compact()
    return index.documents().select("id", "name", "file_path", "code_type", "content")


@query(
    "partial_update", "S28",
    f"""WITH {_DOCS}, l AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'flagged' END AS code_type FROM labels)
    SELECT old.id, name, coalesce(l.code_type, old.code_type) AS code_type FROM old LEFT JOIN l USING (id)""",
)
def partial_update(spark, sf):
    patch = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "flagged").alias("code_type"))
    return N.merge_columns(_docs(spark, sf), patch).select("id", "name", "code_type")


@query("delete_ids", "S29 I8", f"WITH {_DOCS} SELECT id FROM old WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def delete_ids(spark, sf):
    keys = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return N.delete_keys(_docs(spark, sf), keys).select("id")


@query("delete_by_filter", "S30 I27", f"WITH {_DOCS} SELECT id, file_path FROM old WHERE file_path <> 'src3/en' AND NOT starts_with(file_path, 'src1')")
def delete_by_filter(spark, sf):
    rows = N.delete_where(_docs(spark, sf), F.col("file_path") == "src3/en")
    return N.remove_prefix(rows, "src1").select("id", "file_path")


@query(
    "replace_files", "I10 I11",
    f"""WITH {_DOCS}, new AS (SELECT * FROM rev WHERE id NOT LIKE 'p%')
    SELECT id, content FROM old WHERE file_path NOT IN (SELECT file_path FROM new) AND NOT starts_with(file_path, 'src7/') UNION ALL SELECT id, content FROM new""",
)
def replace_files(spark, sf):
    docs = _docs(spark, sf)
    new = _revised(spark, sf).filter(~F.col("id").startswith("p"))
    gone = docs.filter(F.col("file_path").startswith("src7/")).select("file_path").distinct()
    return N.replace_files(docs, new, gone).select("id", "content")


@query(
    "unit_delta", "I9",
    f"""WITH {_DOCS} SELECT coalesce(o.id, r.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' ELSE 'modified' END AS op
    FROM old o FULL OUTER JOIN rev r ON o.id = r.id WHERE o.content IS DISTINCT FROM r.content""",
)
def unit_delta(spark, sf):
    hashed = [d.select("id", F.col("content").alias("content_hash")) for d in (_docs(spark, sf), _revised(spark, sf))]
    return N.unit_delta(*hashed)


# --- tasks and index statistics ----------------------------------------------------------------------


def _tasks(spark, sf):
    """One row per (order, part): the order is the task, its priority the order priority."""
    o = D.table(spark, sf, "orders")
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("task_id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"),
        F.col("o_orderdate").alias("created_at"), F.col("l_partkey").alias("file_path"), status.alias("status"),
    )


_TASKS = """tasks AS (SELECT o_orderkey AS task_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS priority, o_orderdate AS created_at, l_partkey AS file_path,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("merge_tasks", "I12 I18", f"WITH {_TASKS} SELECT task_id, min(priority) AS priority, min(created_at) AS created_at, count(file_path) AS files FROM tasks WHERE status = 'pending' GROUP BY 1")
def merge_tasks(spark, sf):
    return N.merged_tasks(_tasks(spark, sf))


@query("next_tasks", "R20 I18", f"WITH {_TASKS} SELECT task_id, min(priority) AS priority, count(file_path) AS files FROM tasks WHERE status = 'pending' GROUP BY 1 ORDER BY min(priority), min(created_at), task_id LIMIT 25")
def next_tasks(spark, sf):
    return N.next_tasks(_tasks(spark, sf), 25).select("task_id", "priority", "files")


@query(
    "task_status", "A17 A18 I18",
    """WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders)
    SELECT pending, CAST(0 AS BIGINT) AS running, completed, failed, CAST(0 AS BIGINT) AS cancelled, round(completed / (completed + failed)::DOUBLE, 6) AS success_rate, pending = 0 AS is_idle FROM c""",
)
def task_status(spark, sf):
    o = D.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return N.task_status(o.select(status.alias("status"))).withColumn("success_rate", F.round("success_rate", 6))


@query("task_batches", "I14 I16", "SELECT CAST(count(*) AS BIGINT) AS files, true AS small_enough FROM orders")
def task_batches(spark, sf):
    files = D.table(spark, sf, "orders").select(F.format_string("orders/%d.py", "o_orderkey").alias("file_path"))
    sizes = N.task_batches(files).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("files"), (F.max("n") <= 50).alias("small_enough"))


@query(
    "index_stats", "A9 T26",
    """WITH f AS (SELECT lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS suffix, length(html) AS units, CASE WHEN starts_with(url, 'https') THEN 'https' ELSE 'unknown' END AS language FROM pages)
    SELECT CASE WHEN grouping(language) = 0 THEN language END AS language, CASE WHEN grouping(suffix) = 0 THEN suffix END AS suffix, CAST(grouping(language, suffix) AS BIGINT) AS level,
    count(*) AS files, CAST(sum(units) AS BIGINT) AS units FROM f GROUP BY GROUPING SETS ((language), (suffix), ())""",
)
def index_stats(spark, sf):
    files = D.table(spark, sf, "pages").select(
        F.when(F.col("url").startswith("https"), "https").alias("language"), F.col("url").alias("file_path"), F.length("html").alias("units")
    )
    return M.index_stats(files)


@query(
    "index_result", "A16",
    "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total_indexed, CAST(sum(l_partkey) AS BIGINT) AS total_updated, CAST(sum(l_suppkey) AS BIGINT) AS total_deleted, count(*) AS errors FROM lineitem",
)
def index_result(spark, sf):
    li = D.table(spark, sf, "lineitem")
    return M.index_result(
        li.select(F.col("l_linenumber").cast("bigint").alias("indexed"), F.col("l_partkey").alias("updated"), F.col("l_suppkey").alias("deleted"), F.lit(1).alias("errors"))
    )
