"""Bounded samples of labelled documents, chosen by a hash of the id, the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents longer than this never train a model; they are scored whole like all others.
MAX_TRAIN_CHARS = 60_000


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def held_out(id_column: str, parts: int, remainder: int) -> Column:
    """Whether a row is kept from training; a null id is not in the fold, though it never trains either."""
    return F.coalesce(fold(id_column, parts) == remainder, F.lit(False))


def sample_ids(docs: DataFrame, labels: DataFrame, label: str, values: list, per_value: int) -> DataFrame | None:
    """``doc_id`` and ``label`` of at most ``per_value`` documents of each label value, first by a hash of the id.

    Ids are ranked without their texts. Repeated ids count once; an id with two labels is taken with each.
    """
    ids = docs.filter(F.col("text").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS)).select("doc_id")
    named = labels.select("doc_id", F.col(label).alias("label")).dropna()
    chosen = None
    for value in values:
        own = (
            ids.join(named.filter(F.col("label") == F.lit(value)), "doc_id")
            .select("doc_id", "label")
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_value)
        )
        chosen = own if chosen is None else chosen.unionByName(own)
    return None if chosen is None else chosen.distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, values: list, per_value: int) -> list[tuple]:
    """(doc_id, text, label) of the bounded sample; texts are fetched by a join with the bounded id table."""
    chosen = sample_ids(docs, labels, label, values, per_value)
    if chosen is None:
        return []
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    found = {r.doc_id: (r.doc_id, r.text, r.label) for r in rows if r.text is not None}
    return [found[k] for k in sorted(found)]
