"""Units and nodes as index documents (inventory P24, P25, S35, F18, F31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.functions import text as T
from codegrove.sources.models import Embedder, embed


def documents_of(units: DataFrame, embedder: Embedder | None = None, content_limit: int | None = None) -> DataFrame:
    """P25: one document per unit. The whole content is searchable, unless ``content_limit`` cuts it."""
    content = F.col("content") if content_limit is None else T.truncated(F.col("content"), content_limit)
    meta = F.to_json(F.struct("decorators", "base_classes", "parent_id"))
    rows = units
    if embedder is not None:
        text = T.unit_embedding_text(F.col("signature"), F.col("docstring"), F.col("content"))
        rows = embed(rows, text, embedder)
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    return rows.select(
        "id", T.document_key(F.col("id")).alias("doc_key"), "name", "qualified_name",
        F.col("type").alias("code_type"), "file_path", "line_start", "line_end",
        content.alias("content"), "language",
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.coalesce("docstring", F.lit("")).alias("docstring"),
        F.col("embedding").cast("array<float>").alias("embedding"), meta.alias("metadata"),
    )


def hit_defaults(raw: DataFrame) -> DataFrame:
    """Stored documents as hits: missing texts are empty, missing lines 0."""
    texts = ("name", "qualified_name", "code_type", "file_path", "content", "language")
    return raw.select(
        "id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts],
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("line_start", "line_end")],
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def documents_from_graph(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Graph nodes joined with their file's text; the content is the node's line range.

    A file with many nodes is read once and joined on its path; only the sliced lines are kept.
    """
    text = F.coalesce("content", F.lit(""))
    joined = nodes.join(files.select("file_path", "content"), "file_path", "left")
    last = F.coalesce("line_end", F.size(T.lines(text)))
    body = F.when(text == "", "").otherwise(
        T.line_slice(text, F.coalesce("line_start", F.lit(1)), last)
    )
    return joined.select(
        "id", T.document_key(F.col("id")).alias("doc_key"), "name", "qualified_name",
        F.col("node_type").alias("code_type"), F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("line_start", F.lit(0)).alias("line_start"),
        F.coalesce("line_end", F.lit(0)).alias("line_end"), body.alias("content"),
        F.coalesce(T.parse_language(F.col("file_path")), F.lit("unknown")).alias("language"),
    )
