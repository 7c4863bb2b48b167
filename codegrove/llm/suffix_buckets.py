"""Bytes covered by repeated strings, found by bucket-pointer refinement over a sparse set of suffixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in another row or in the same text; matches never cross
rows. As in a suffix array built by bucket-pointer refinement, suffixes are dealt into buckets of equal q-grams first; a bucket is then refined
by the identifiers of what stands at later offsets, within the bucket that the suffix points to, and the new identifiers are the pointers of
the next round. What is left out of the classic form is the order inside a bucket, as only equality is asked for, and most suffixes:

1. A start p belongs to the anchor a(p), the leftmost q-gram of least hash inside its string. Equal strings have equal anchors at equal distances
   d = a - p, so only anchors are bucketed: one per 70 bytes. An anchor answers for a run of starts, d in [lo, hi].
2. The first bucket is the anchor's q-gram. Buckets of one anchor are dropped. Anchors of a bucket whose whole stretch (all their strings
   together) is the same are done: all their starts repeat.
3. Buckets of several stretches are refined: [lo, hi] is cut into ranges of distances on one grid. A range's bucket is its parent's bucket with
   the identifier of the bytes that all strings of the range have in common. Single ones are dropped, equal stretches are done, the
   others are cut again, down to single distances, where the common bytes are the whole string.

Every round is a grouping on bucket identifiers with partial aggregates, so that a passage of a third of all rows is one row per task; within a
chunk equal stretches are one row from the start. A bucket's rows are joined back to its outcome, both written first, so that skewed
buckets are split. Texts leave the scan twice: those with refined anchors, and those that lose bytes.

Identifiers are 64-bit hashes. A stretch is compared within its bucket only; a wrong match needs two different stretches of one bucket with
one hash (m * m / 2**65 for m of them). Rows are known by a hash of id and text: n * n / 2**65 expected clashes.

Null texts count as empty: no bytes. Null ids, ties and repeated rows are ordinary: repeated rows are copies of each other, so all their strings
repeat. Texts shorter than ``length`` lose nothing. An empty table gives an empty result. All columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.staging import Stage

#: Key tables of at most this many rows (8 bytes each) are sent to all tasks; larger ones are joined by shuffle.
SENT_KEYS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``length``: bytes of a repeated string; ``gram``: bytes of the first buckets; ``fan``: parts into which a range is cut."""

    length: int = 200
    gram: int = 64
    fan: int = 12

    def __post_init__(self):
        if not 0 < self.gram <= self.length or self.length - self.gram >= 256 or self.fan < 2:
            raise ValueError("gram must be within length and less than 256 below it, fan 2 or more")


def row_key():
    """Key of a document: its id and text."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def least_starts(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, where its least one stands first."""
    at, size, least = np.arange(len(h), dtype=np.int32), 1, h
    while size < width:
        step = min(size, width - size)
        left, right = least[:-step], least[step:]
        at = np.where(left <= right, at[:-step], at[step:])
        least = np.minimum(left, right)
        size += step
    return at


def anchors(chunk: A.Chunk, s: Settings) -> tuple[np.ndarray, ...]:
    """Row, bucket, stretch, first start, last start and place of the anchors of a chunk; positions count from the chunk's begin."""
    data, none = chunk.data, np.zeros(0, dtype=np.int64)
    n = len(data)
    if n < s.length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    starts = np.arange(n - s.gram + 1)
    grams = chunk.hashes(starts, starts + s.gram)
    place = least_starts(grams, s.length - s.gram + 1)
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))[: len(place)]
    inside = np.arange(len(place)) + s.length <= chunk.offsets[row + 1]
    new = np.append(True, (place[1:] != place[:-1]) | ~inside[:-1])
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    at = place[first].astype(np.int64)
    stretch = chunk.hashes(first, last + s.length)
    stretch = A.mix(stretch + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    return row[first], grams[at], stretch, first, last, at


def _anchor_rows(s: Settings):
    """core, full, key, place: an anchor, once per chunk for equal stretches; core null: a repeated run of bytes, ``full`` to ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for chunk in A.chunks(A.text_column(batch)):
                row, core, full, first, last, at = anchors(chunk, s)
                if not len(row):
                    continue
                both = A.mix(core + A.mix(full))
                _, where, group, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
                begin = first - chunk.offsets[row]
                place = (begin << 17) | ((last - first) << 9) | ((at - first) << 1) | (count[group] > 1)
                sent = np.sort(where)
                # runs of anchors that repeat within the chunk, side by side in one row
                twin = np.flatnonzero(count[group] > 1)
                joined = (row[twin[1:]] == row[twin[:-1]]) & (first[twin[1:]] <= last[twin[:-1]] + s.length)
                opens, ends = np.append(True, ~joined)[: len(twin)], np.append(~joined, True)[-len(twin) :] if len(twin) else np.zeros(0, bool)
                lo, hi = twin[opens], twin[ends]
                nulls = np.append(np.zeros(len(sent), bool), np.ones(len(lo), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(core[sent].view(np.int64), np.zeros(len(lo), np.int64)), mask=nulls),
                        pa.array(np.append(full[sent].view(np.int64), begin[lo])),
                        pa.array(keys[chunk.lo + np.append(row[sent], row[lo])]),
                        pa.array(np.append(place[sent], last[hi] + s.length - chunk.offsets[row[hi]])),
                    ],
                    ["core", "full", "key", "place"],
                )

    return run


def _bit(name: str, shift: int, bits: int):
    return F.shiftright(F.col(name), shift).bitwiseAND((1 << bits) - 1)


def _begin(column: str = "place"):
    return F.shiftright(F.col(column), 17)


def _stretch_runs(rows: DataFrame, s: Settings) -> DataFrame:
    """The bytes of whole stretches."""
    return rows.select("key", _begin().alias("lo"), (_begin() + _bit("place", 9, 8) + s.length).alias("hi"))


def _contexts(s: Settings):
    """The bytes around the asked anchors of each text: key, place, core, single, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = A.text_column(batch)
            data, offsets = A.raw(texts)
            lists = batch.column(2)
            asked = lists.flatten()
            place, core, single = (asked.field(i) for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            p = place.to_numpy()
            lo = offsets[row] + (p >> 17)
            hi = lo + ((p >> 9) & 255) + s.length
            keys = batch.column(0).to_numpy()
            for i in range(0, len(p), 4000):
                part = slice(i, i + 4000)
                cut = [data[a:b].tobytes() for a, b in zip(lo[part].tolist(), hi[part].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row[part]]), place[part], core[part], single[part], pa.array(cut, pa.binary())],
                    ["key", "place", "core", "single", "bytes"],
                )

    return run


def _ranges(width: int, s: Settings):
    """The parts, on a grid of ``width``, of each asked range of distances: key, place, single, part, bucket, full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = {n: batch.column(i) for i, n in enumerate(names)}
            place, above, lo, hi = (column[n].to_numpy() for n in ("place", "bucket", "lo", "hi"))
            key, single = column["key"], column["single"].to_numpy(zero_copy_only=False)
            for chunk in A.chunks(column["bytes"].cast(pa.large_binary())):
                own = slice(chunk.lo, chunk.hi)
                p = place[own]
                to_anchor = (p >> 1) & 255
                farthest, nearest = to_anchor, to_anchor - ((p >> 9) & 255)
                least, most = np.maximum(lo[own], nearest), np.minimum(hi[own], farthest)
                parts = most // width - least // width + 1
                at = np.repeat(np.arange(len(p)), parts)
                part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts) + least[at] // width
                from_d, to_d = part * width, part * width + width - 1
                # the grid's last part may reach beyond all strings
                to_d = np.minimum(to_d, s.length - s.gram)
                anchor = chunk.offsets[at] + to_anchor[at]
                common = chunk.hashes(anchor - from_d, anchor - to_d + s.length)
                bucket = A.mix(above[own].view(np.uint64)[at] + A.mix(common + part.astype(np.uint64)))
                whole = (from_d >= nearest[at]) & (to_d <= farthest[at])
                full = np.zeros(len(at), dtype=np.uint64)
                full[whole] = chunk.hashes((anchor - to_d)[whole], (anchor - from_d + s.length)[whole])
                index = pa.array(at + chunk.lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        key.take(index), pa.array(place[own][at]), pa.array(single[own][at]), pa.array(part.astype(np.int32)),
                        pa.array(bucket.view(np.int64)), pa.array(full.view(np.int64), mask=~whole),
                    ],
                    ["key", "place", "single", "part", "bucket", "full"],
                )

    return run


def repeated_runs(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """key, lo, hi: runs of bytes of ``docs`` (doc_id, text) covered by repeated strings; runs of a key may overlap. ``key``: ``row_key``."""
    stage = Stage(docs.sparkSession, "suffix-buckets")
    keyed = docs.select(row_key().alias("key"), "text")
    long_enough = keyed.filter(F.octet_length("text") >= s.length)
    rows = stage.table(long_enough.mapInArrow(_anchor_rows(s), "core long, full long, key long, place long"))
    runs = [rows.filter("core is null").select("key", F.col("full").alias("lo"), F.col("place").alias("hi"))]
    rows = rows.filter("core is not null")
    times = F.sum(1 + _bit("place", 0, 1))
    sizes = rows.groupBy("core").agg(times.alias("n"), (F.min("full") != F.max("full")).alias("open")).filter("n > 1").select("core", "open")
    met = stage.table(rows.join(stage.table(sizes), "core"))
    runs.append(_stretch_runs(met.filter("not open"), s))
    several = met.filter("open").select("core", "full", "key", "place")
    one = F.min(F.struct("key", "place")).alias("one")
    stretches = stage.table(several.groupBy("core", "full").agg(times.alias("n"), one))
    again = stretches.filter("n > 1").select("core", "full")
    runs.append(_stretch_runs(several.join(again, ["core", "full"], "left_semi"), s))

    asked = F.struct(F.col("one.place").alias("place"), "core", (F.col("n") == 1).alias("single"))
    lists, n = stage.put(stretches.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(asked).alias("asked")))
    texts = long_enough.join(F.broadcast(lists.select("key")), "key", "left_semi") if n["rows"] <= SENT_KEYS else long_enough
    found = texts.join(lists, "key").select("key", "text", "asked").mapInArrow(
        _contexts(s), "key long, place long, core long, single boolean, bytes binary"
    )
    contexts, n = stage.put(found)
    width = s.length - s.gram + 1
    active = contexts.select("key", "place", "single", "bytes", F.col("core").alias("bucket"), F.lit(0).alias("lo"), F.lit(width - 1).alias("hi"))
    while n["rows"] and width > 1:
        width = -(-width // s.fan)
        parts = stage.table(active.mapInArrow(_ranges(width, s), "key long, place long, single boolean, part int, bucket long, full long"))
        # a repeated row of the table gives the same anchor again, which is no second one
        anchor_id = F.xxhash64("key", "place")
        seen = parts.groupBy("bucket").agg(
            (F.min(anchor_id) != F.max(anchor_id)).alias("several"), (F.count("full") == F.count(F.lit(1))).alias("all"),
            (F.min("full") == F.max("full")).alias("same"),
        )
        seen = stage.table(seen.filter("several").select("bucket", F.expr("all and same").alias("done")))
        kept, n = stage.put(parts.join(seen, "bucket"))
        # the nearest distance of the part comes last in the text
        near = F.col("part") * width
        far = F.least(near + width - 1, F.lit(s.length - s.gram))
        anchor = _begin() + _bit("place", 1, 8)
        runs.append(kept.filter("done and single").select("key", (anchor - far).alias("lo"), (anchor - near + s.length).alias("hi")))
        more = kept.filter("not done").select("key", "place", "bucket", near.alias("lo"), far.alias("hi")).distinct()
        active = contexts.select("key", "place", "single", "bytes").join(more, ["key", "place"])
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given ones."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    opens = np.append(True, lo[1:] > hi[:-1])
    return lo[opens], hi[np.append(opens[1:], True)]


def remove_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All rows and columns of ``docs`` with n_bytes, n_removed, n_spans (long), spans (array of lo, hi) and kept (binary: what is left of the
    text). Columns of these names are lengthened by underscores until no column of ``docs`` has them."""
    stage = Stage(docs.sparkSession, "suffix-cuts")
    names = [A.unused(docs.columns, n) for n in ("n_bytes", "n_removed", "n_spans", "spans", "kept")]
    key, runs = A.unused(docs.columns, "suffix_key"), A.unused(docs.columns, "suffix_runs")
    run = F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    found, n = stage.put(repeated_runs(docs, s).groupBy(F.col("key").alias(key)).agg(F.collect_list(run).alias(runs)))
    keyed = docs.withColumn(key, row_key())
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    nothing = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    clean_values = [F.octet_length(text).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), nothing, text]
    if n["rows"] <= SENT_KEYS:
        # texts that keep all bytes stay where they are
        sent = F.broadcast(found.select(key))
        clean, marked = keyed.join(sent, key, "left_anti"), keyed.join(sent, key, "left_semi").join(found, key)
    else:
        both = keyed.join(found, key, "left")
        clean, marked = both.filter(F.col(runs).isNull()), both.filter(F.col(runs).isNotNull())
    clean = clean.select(*docs.columns, *(v.alias(c) for v, c in zip(clean_values, names)))
    at = len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 500):
                part = batch.slice(base, 500)
                data, offsets = A.raw(A.text_column(part))
                lists = part.column(at)
                flat, size = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                columns = [[], [], [], [], []]
                for r in range(part.num_rows):
                    a, b = merged(lo[size[r] : size[r + 1]], hi[size[r] : size[r + 1]])
                    own = data[offsets[r] : offsets[r + 1]]
                    gaps = zip(np.append(0, b).tolist(), np.append(a, len(own)).tolist())
                    kept = b"".join(own[i:j].tobytes() for i, j in gaps)
                    spans = [{"lo": i, "hi": j} for i, j in zip(a.tolist(), b.tolist())]
                    for column, v in zip(columns, (len(own), len(own) - len(kept), len(a), spans, kept)):
                        column.append(v)
                kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *(pa.array(c, k) for c, k in zip(columns, kinds))], [*docs_names, *names])

    docs_names = docs.columns
    return clean.unionByName(marked.select(*docs.columns, runs).mapInArrow(cut, clean.schema))
