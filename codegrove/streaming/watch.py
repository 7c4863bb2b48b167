"""File watching and continuous indexing (inventory I1-I4, I13-I18, I28, G16, T16).

A trigger takes the place of the poll loop, ``maxFilesPerTrigger`` that of rate limits and task batches,
and the checkpoint that of the queue. Deletions never show up in a file stream, so every trigger can
also compare a directory snapshot with the stored one.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from codegrove.functions import text as T
from codegrove.operators.documents import documents_of
from codegrove.operators.extraction import extract
from codegrove.operators.filters import watched
from codegrove.operators.snapshots import compare, latest_changes, update_plan
from codegrove.sources.files import BINARY_SCHEMA, SOURCE_GLOB, file_hashes, source_files
from codegrove.sources.graph_store import load_state, save_state
from codegrove.sources.index_store import DocumentIndex

log = logging.getLogger(__name__)
Handler = Callable[[DataFrame, int], None]


def file_stream(
    spark: SparkSession, directory: str, glob: str = SOURCE_GLOB, files_per_trigger: int = 50,
    patterns: Sequence[str] = ("*.py", "*.php"),
) -> DataFrame:
    """New and changed files as a stream of (file_path, modified, content)."""
    rows = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_trigger)).load(directory)
    )
    path = F.regexp_replace("path", "^file:(//)?", "")
    return rows.select(
        path.alias("file_path"), F.col("modificationTime").alias("modified"),
        F.col("content").cast("string").alias("content"),
    ).filter(watched(F.col("file_path"), patterns))


def fan_out(handlers: Sequence[Handler]) -> Handler:
    """Call every handler with the batch; one failing handler does not stop the others.

    Errors are raised together at the end, so the batch is retried rather than lost.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        errors = []
        try:
            for handler in handlers:
                try:
                    handler(batch, batch_id)
                except Exception as exc:
                    log.exception("handler failed in batch %s", batch_id)
                    errors.append(exc)
        finally:
            batch.unpersist()
        if errors:
            raise ExceptionGroup(f"batch {batch_id}", errors)

    return run


def change_sink(path: str, order: str = "timestamp") -> Handler:
    """Keeps the last change of every path of a batch; each batch is one folder, rewritten on retry."""

    def run(batch: DataFrame, batch_id: int) -> None:
        last = latest_changes(batch, F.struct(order, *[c for c in batch.columns if c not in ("path", order)]))
        last.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def index_sink(index: DocumentIndex, stream: str = "watch") -> Handler:
    """Parse the files of a batch and replace their documents in one step of the index, named by stream and batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("file_path").agg(F.max_by("content", "modified").alias("content"))
        _, units = extract(latest)
        index.change(
            upserts=documents_of(units), deleted_files=latest.select("file_path"), step=f"{stream}-{batch_id}"
        )

    return run


def start(
    stream: DataFrame, handler: Handler, checkpoint: str, every: str | None = None, name: str | None = None
) -> StreamingQuery:
    """Run a handler per micro-batch; without ``every`` it drains what is there and stops."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def wait(query: StreamingQuery, timeout: float | None = None) -> bool:
    """True when the query has finished within the timeout."""
    if timeout is None:
        query.awaitTermination()
        return True
    return bool(query.awaitTermination(timeout))


def refresh(spark: SparkSession, directory: str, state_path: str, index: DocumentIndex) -> dict[str, int]:
    """Compare the directory with the stored snapshot and apply the difference.

    State is written after the index, so a crash in between only repeats idempotent work.
    """
    current = file_hashes(spark, directory, ("*.py", "*.php")).persist()
    try:
        diff = compare(load_state(spark, state_path), current)
        plan = update_plan(diff).persist()
        counts = {r.status: r["count"] for r in plan.groupBy("status").count().collect()}  # three rows
        if counts:
            changed = plan.filter(F.col("action") == "index").select("file_path")
            texts = source_files(spark, directory, only=changed)
            _, units = extract(texts)
            index.change(upserts=documents_of(units), deleted_files=plan.select("file_path"))
            kept = current.select("file_path", "content_hash", "mtime", "size")
            save_state(kept, state_path)
        plan.unpersist()
        return {k: counts.get(k, 0) for k in ("added", "modified", "deleted")}
    finally:
        current.unpersist()


def language_counts(stream: DataFrame) -> DataFrame:
    """Running number of files by language (A9 over a stream)."""
    return stream.groupBy(T.listing_language(F.col("file_path")).alias("language")).count()
