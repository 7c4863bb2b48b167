"""File scans (inventory S1, S7-S13, F8): Spark reads files in parallel, nothing is listed on the driver
beyond Spark's own file index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrove.functions import text as T
from codegrove.operators.filters import (
    HASH_SKIPPED_PARTS, SKIPPED_PARTS, any_glob, any_name, skipped_in_hash, skipped_in_index, validate_path,
)

SOURCE_GLOB = "*.{py,php}"
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _path():
    return F.regexp_replace("path", "^file:(//)?", "")


def binary_files(
    spark: SparkSession, paths: str | Sequence[str], glob: str = "*", recursive: bool = True, skip: Sequence[str] = ()
) -> DataFrame:
    """Raw scan: (file_path, modified, size, content).

    Files with one of the ``skip`` parts in their path are left out when files are listed, by a filter on the file's metadata, so they are
    not opened at all.
    """
    for path in [paths] if isinstance(paths, str) else paths:
        if not validate_path(path):
            raise ValueError(f"unsafe path: {path}")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    reader = reader.option("recursiveFileLookup", "true" if recursive else "false")
    rows = reader.load([paths] if isinstance(paths, str) else list(paths))
    if skip:
        rows = rows.filter(~T.mentions_any(F.col("_metadata.file_path"), skip))
    return rows.select(
        _path().alias("file_path"), F.col("modificationTime").alias("modified"),
        F.col("length").alias("size"), "content",
    )


def source_files(
    spark: SparkSession, paths: str | Sequence[str], glob: str = SOURCE_GLOB, recursive: bool = True,
    languages: Sequence[str] | None = None, exclude: Sequence[str] = (), only: DataFrame | None = None,
) -> DataFrame:
    """(file_path, content) of source files; excluded folders, globs and languages left out.

    Excluded folders are not opened. With ``only`` (file_path), just these files are opened: their names go to the driver, which lists
    files in any case.
    """
    if only is not None:
        paths = sorted(r.file_path for r in only.select("file_path").distinct().collect())
        if not paths:
            return spark.createDataFrame([], "file_path string, content string")
    rows = binary_files(spark, paths, glob, recursive, SKIPPED_PARTS).filter(~skipped_in_index(F.col("file_path")))
    if exclude:
        rows = rows.filter(~any_glob(F.col("file_path"), exclude))
    if languages:
        rows = rows.filter(T.parse_language(F.col("file_path")).isin(*languages))
    return rows.select("file_path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Texts of a list of files, read in parallel; ``persist`` it to reuse it."""
    return binary_files(spark, paths, recursive=False).select("file_path", F.col("content").cast("string").alias("content"))


def file_hashes(
    spark: SparkSession, directory: str, patterns: Sequence[str] = ("*",), exclude: Sequence[str] = ()
) -> DataFrame:
    """(file_path, content_hash, mtime, size) of a directory tree."""
    rows = binary_files(spark, directory, skip=HASH_SKIPPED_PARTS)
    if tuple(patterns) != ("*",):
        rows = rows.filter(any_name(F.col("file_path"), patterns))
    rows = rows.filter(~skipped_in_hash(F.col("file_path"), exclude))
    return rows.select(
        "file_path", F.sha2("content", 256).alias("content_hash"),
        (F.unix_micros("modified") / 1_000_000).alias("mtime"), "size",
    )


def modification_times(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """(file_path, mtime) without reading any content."""
    return binary_files(spark, directory, recursive=recursive).select(
        "file_path", (F.unix_micros("modified") / 1_000_000).alias("mtime")
    )
