"""Snapshots, changes, upserts and deltas (inventory J16, U1, U2, I2, I3, I5-I11, I27, S27-S31, A17, A18, R20, I12, I14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.operators.filters import any_name

# Name globs of an incremental index; Python and PHP are both parsed.
INDEX_PATTERNS = ("*.py", "*.php", "*.js", "*.ts", "*.java", "*.go", "*.rs")
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = (
    "pending", "running", "completed", "failed", "cancelled",
)


def compare(previous: DataFrame, current: DataFrame, key: str = "file_path", value: str = "content_hash") -> DataFrame:
    """One row per key with its status added, modified, deleted or unchanged.

    A union and one grouped pass instead of a full outer join: only key and value are shuffled and both
    sides are aggregated before the shuffle.
    """
    sides = previous.select(key, F.col(value).alias("old"), F.lit(None).cast(current.schema[value].dataType).alias("new")).unionByName(
        current.select(key, F.lit(None).cast(previous.schema[value].dataType).alias("old"), F.col(value).alias("new"))
    )
    both = sides.groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old") != F.col("new"), "modified")
        .otherwise("unchanged")
    )
    return both.select(key, status.alias("status"))


def update_plan(comparison: DataFrame, key: str = "file_path") -> DataFrame:
    """Action per changed file: index for added and modified, remove for deleted."""
    action = F.when(F.col("status").isin("added", "modified"), "index").when(
        F.col("status") == "deleted", "remove"
    )
    return comparison.select(key, "status", action.alias("action")).filter(F.col("action").isNotNull())


def watch_events(previous: DataFrame, current: DataFrame, at: Column, key: str = "file_path") -> DataFrame:
    """Change events between two polls (by modification time)."""
    diff = compare(previous, current, key, "mtime")
    kind = F.create_map(
        F.lit("added"), F.lit("created"), F.lit("modified"), F.lit("modified"),
        F.lit("deleted"), F.lit("deleted"),
    )
    return diff.filter(F.col("status") != "unchanged").select(
        F.col(key).alias("path"), kind[F.col("status")].alias("change_type"), at.alias("timestamp")
    )


def latest_changes(changes: DataFrame, order: Column | None = None) -> DataFrame:
    """The last change of each path (partial ``max_by``: one row per path and task is shuffled)."""
    others = [c for c in changes.columns if c != "path"]
    rank = order if order is not None else F.col("timestamp")
    return changes.groupBy("path").agg(F.max_by(F.struct(*others), rank).alias("c")).select("path", "c.*")


def planned_from_changes(changes: DataFrame, patterns=INDEX_PATTERNS) -> DataFrame:
    """Deletions are always taken, creations and modifications only for indexed names."""
    wanted = any_name(F.col("path"), patterns)
    action = F.when(F.col("change_type") == "deleted", "remove").when(
        F.col("change_type").isin("created", "modified") & wanted, "index"
    )
    return changes.select("path", "change_type", action.alias("action")).filter(F.col("action").isNotNull())


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones with the same key; new keys must be unique."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_columns(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Partial update: only the columns present and not NULL in ``new`` change."""
    changed = [c for c in new.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = old.join(renamed, key, "full_outer")
    columns = [
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
        for c in old.columns
    ]
    return joined.select(*columns)


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not listed."""
    return table.join(keys.select(key), key, "left_anti")


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true."""
    return table.filter(~F.coalesce(predicate, F.lit(False)))


def replace_files(old: DataFrame, new: DataFrame, deleted: DataFrame, key: str = "file_path") -> DataFrame:
    """Delete-then-insert per file: rows of changed and deleted files go, new ones come."""
    touched = new.select(key).unionByName(deleted.select(key)).distinct()
    return delete_keys(old, touched, key).unionByName(new)


def remove_prefix(table: DataFrame, prefix: str, key: str = "file_path") -> DataFrame:
    """Forget everything below a path."""
    return table.filter(~F.col(key).startswith(prefix))


def unit_delta(old_units: DataFrame, new_units: DataFrame) -> DataFrame:
    """(id, op) with op added, removed or modified."""
    names = F.create_map(
        F.lit("added"), F.lit("added"), F.lit("deleted"), F.lit("removed"), F.lit("modified"), F.lit("modified")
    )
    diff = compare(old_units, new_units, "id", "content_hash")
    return diff.filter(F.col("status") != "unchanged").select("id", names[F.col("status")].alias("op"))


def merged_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks with one id become one: files united, most urgent priority, first time.

    Input is one row per (task_id, file_path). The result has one row per task and no file list: the
    files stay rows, see ``task_files``.
    """
    return tasks.filter(F.col("status") == PENDING).groupBy("task_id").agg(
        F.min("priority").alias("priority"), F.min("created_at").alias("created_at"),
        F.count("file_path").alias("files"),
    )


def next_tasks(tasks: DataFrame, limit: int = 1) -> DataFrame:
    """The tasks to run next, by (priority, created_at)."""
    return merged_tasks(tasks).orderBy("priority", "created_at", "task_id").limit(limit)


def task_batches(files: DataFrame, partitions: int = 200, size: int = 50) -> DataFrame:
    """Assign files to batches of at most ``size``.

    Files are numbered inside hash partitions, so no single task ever orders them all.
    """
    from pyspark.sql.window import Window

    part = F.pmod(F.xxhash64("file_path"), F.lit(partitions)).cast("int")
    w = Window.partitionBy("part").orderBy("file_path")
    numbered = files.select("file_path", part.alias("part")).withColumn("rn", F.row_number().over(w))
    return numbered.select(
        "file_path", F.concat_ws("-", "part", F.floor((F.col("rn") - 1) / size).cast("int")).alias("task_id")
    )


def task_status(tasks: DataFrame) -> DataFrame:
    """Counts by status on one row, and the success rate (1 when nothing has finished)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (PENDING, RUNNING, COMPLETED, FAILED, CANCELLED)]
    row = tasks.agg(*counts)
    finished = F.col(COMPLETED) + F.col(FAILED)
    rate = F.coalesce(F.try_divide(F.col(COMPLETED).cast("double"), finished), F.lit(1.0))
    idle = (F.col(PENDING) == 0) & (F.col(RUNNING) == 0)
    return row.withColumn("success_rate", rate).withColumn("is_idle", idle)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
