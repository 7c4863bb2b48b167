"""Units -> chunks (inventory K1-K7, F15-F17).

Greedy chunk borders depend on everything before them, so they are found by a small Arrow UDF.
Only integers cross to Python: line lengths go in, line or character ranges come out, and Spark cuts
the text. Units that fit in one chunk never reach the UDF.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.functions import text as T

_RANGES = "array<struct<first:int,last:int,tail_first:int,tail_last:int>>"
_SPANS = "array<struct<start:int,stop:int,is_tail:boolean>>"

# Line starts that make the preceding newline a good place to split.
BOUNDARY_PREFIXES = ("def ", "async def ", "class ", "    def ", "    async def ")


@dataclass(frozen=True)
class ChunkSizes:
    maximum: int
    overlap: int
    minimum: int


PARSING_SIZES = ChunkSizes(6000, 200, 100)
EMBEDDING_SIZES = ChunkSizes(2000, 200, 100)


def line_ranges(lengths: list[int], sizes: ChunkSizes) -> list[tuple[int, int]]:
    """Greedy fill as jumps over prefix sums: (first, last) line of every chunk, before dropping.

    A chunk starts with the overlap carried over from its predecessor plus one forced line and
    then takes every further line that still fits.
    """
    ends = [0, *accumulate(n + 1 for n in lengths)]
    total, first, forced, out = len(lengths), 0, 0, []
    while forced < total:
        fit = bisect_right(ends, ends[first] + sizes.maximum) - 1
        stop = max(fit, forced + 1)
        out.append((first, stop - 1))
        carry = stop
        while carry > first and ends[stop] - ends[carry - 1] <= sizes.overlap:
            carry -= 1
        first, forced = carry, stop
    return out


def _size(lengths: list[int], first: int, last: int) -> int:
    return sum(lengths[first:last + 1]) + last - first


def parsing_ranges(lengths: list[int], sizes: ChunkSizes) -> list[dict]:
    """K1: chunks below the minimum are dropped, except a lone last one."""
    kept = []
    found = line_ranges(lengths, sizes)
    for i, (first, last) in enumerate(found):
        lone_tail = i == len(found) - 1 and not kept
        if lone_tail or _size(lengths, first, last) >= sizes.minimum:
            kept.append(dict(first=first, last=last, tail_first=-1, tail_last=-1))
    return kept


def embedding_ranges(lengths: list[int], sizes: ChunkSizes) -> list[dict]:
    """K6: only the last chunk can be too small; it is appended to the one before."""
    rows = [
        dict(first=a, last=b, tail_first=-1, tail_last=-1)
        for a, b in line_ranges(lengths, sizes)
    ]
    if len(rows) > 1 and _size(lengths, rows[-1]["first"], rows[-1]["last"]) < sizes.minimum:
        tail = rows.pop()
        rows[-1].update(tail_first=tail["first"], tail_last=tail["last"])
    return rows


def split_positions(lengths: list[int], marked: list[bool], sizes: ChunkSizes) -> list[int]:
    """K5: split positions, walking from newline to newline instead of character by character.

    ``marked[i]`` says that the newline after line i is a natural boundary. A forced split happens
    at the first newline less than 200 characters away once the chunk is nearly full.
    """
    near_full = sizes.maximum - sizes.overlap
    points: list[int] = []
    size, pos = 0, 0  # characters since the last split, next unread position
    for i, length in enumerate(lengths[:-1]):
        newline = pos + length if i == 0 else newline + length + 1
        while pos < newline:
            full_at = pos + max(near_full - size, 1) - 1
            at = max(full_at, newline - 199, pos)
            if at >= newline:
                size += newline - pos
                pos = newline
                break
            points.append(newline + 1)
            size, pos = 0, at + 1
        size += 1
        pos = newline + 1
        if marked[i] and sizes.minimum <= size <= sizes.maximum:
            points.append(newline)
            size = 0
        if size >= near_full:
            points.append(newline + 1)
            size = 0
    return points


def smart_spans(lengths: list[int], marked: list[bool], sizes: ChunkSizes) -> list[dict]:
    """K4: character spans between usable split positions; the last one is the tail."""
    total = sum(lengths) + len(lengths) - 1
    spans, start = [], 0
    points = split_positions(lengths, marked, sizes)
    for point in points:
        if point - start >= sizes.minimum:
            spans.append(dict(start=start, stop=point, is_tail=False))
            start = point
    if points and start < total:
        spans.append(dict(start=start, stop=total, is_tail=True))
    return spans


def _line_lengths(text: Column, limit: int) -> Column:
    """Line lengths of texts over the limit; an empty array keeps short ones away from Python."""
    lengths = F.transform(T.lines(text), lambda s: F.length(s))
    return F.when(F.length(text) > limit, lengths).otherwise(F.array().cast("array<int>"))


def _range_udf(finder, sizes: ChunkSizes):
    @F.pandas_udf(_RANGES)
    def ranges(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda row: finder([int(n) for n in row], sizes) if len(row) else [])

    return ranges.asNondeterministic()  # never repeated in derived filters


def _span_udf(sizes: ChunkSizes):
    @F.pandas_udf(_SPANS)
    def spans(lengths: pd.Series, marked: pd.Series) -> pd.Series:
        return pd.Series(
            [
                smart_spans([int(n) for n in a], [bool(x) for x in b], sizes) if len(a) else []
                for a, b in zip(lengths, marked)
            ]
        )

    return spans.asNondeterministic()


def _pick(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def _whole(content: Column) -> Column:
    return F.array(content)


def _parsing_chunks(units: DataFrame, texts: Column, context: Column) -> DataFrame:
    """One row per element of ``texts`` with the columns of a parsing chunk."""
    return units.select(
        "*", F.size(texts).alias("total_chunks"),
        F.posexplode(texts).alias("chunk_index", "chunk_text"),
    ).select(
        F.concat(F.col("id"), F.lit("::"), F.col("chunk_index")).alias("id"),
        F.col("id").alias("unit_id"),
        F.col("chunk_text").alias("content"),
        "chunk_index", "total_chunks",
        context.alias("context_before"),
        F.lit(None).cast("string").alias("context_after"),
        "file_path", "language", F.col("type").alias("unit_type"),
        F.col("qualified_name").alias("unit_name"),
    )


def _header() -> Column:
    return T.file_header(
        F.col("file_path"), F.col("type"), F.col("qualified_name"), F.col("signature"),
        F.col("docstring"),
    )


def chunk_for_parsing(units: DataFrame, sizes: ChunkSizes = PARSING_SIZES) -> DataFrame:
    """K1/K2: line-based chunks with overlap, small ones dropped, comment header as context."""
    content = F.col("content")
    ranged = units.withColumn(
        "_r", _range_udf(parsing_ranges, sizes)(_line_lengths(content, sizes.maximum))
    )
    lines = T.lines(content)
    texts = F.when(
        F.length(content) > sizes.maximum,
        F.transform("_r", lambda r: _pick(lines, r["first"], r["last"])),
    ).otherwise(_whole(content))
    return _parsing_chunks(ranged.withColumn("_t", texts), F.col("_t"), _header())


def chunk_smart(units: DataFrame, sizes: ChunkSizes = PARSING_SIZES) -> DataFrame:
    """K4: split at definitions and empty lines where possible, else like ``chunk_for_parsing``."""
    content = F.col("content")
    lines = T.lines(content)

    def boundary(line: Column) -> Column:
        test = line == ""
        for prefix in BOUNDARY_PREFIXES:
            test = test | line.startswith(prefix)
        return test

    # the empty last line of a text has no newline after it, hence nothing to split at
    following = F.transform(F.slice(lines, 2, F.size(lines)), boundary)
    inner = F.transform(
        following,
        lambda ok, i: F.when(i == F.size(lines) - 2, ok & (F.element_at(lines, -1) != "")).otherwise(ok),
    )
    lengths = _line_lengths(content, sizes.maximum)
    long = F.length(content) > sizes.maximum
    work = units.withColumn("_s", _span_udf(sizes)(lengths, F.when(long, inner).otherwise(F.array())))
    work = work.withColumn("_r", _range_udf(parsing_ranges, sizes)(lengths))
    cut = F.transform(
        "_s",
        lambda s: F.struct(
            T.strip(F.substr(content, s["start"] + 1, s["stop"] - s["start"])).alias("text"),
            s["is_tail"].alias("is_tail"),
        ),
    )
    kept = F.transform(
        F.filter(
            cut, lambda c: F.length(c["text"]) >= F.when(c["is_tail"], sizes.minimum).otherwise(1)
        ),
        lambda c: c["text"],
    )
    plain = F.transform("_r", lambda r: _pick(lines, r["first"], r["last"]))
    texts = (
        F.when(~long, _whole(content)).when(F.size("_k") > 0, F.col("_k")).otherwise(plain)
    )
    work = work.withColumn("_k", kept).withColumn("_t", texts)
    return _parsing_chunks(work, F.col("_t"), _header())


def chunk_for_embedding(
    units: DataFrame, sizes: ChunkSizes = EMBEDDING_SIZES, include_context: bool = True
) -> DataFrame:
    """K6: chunks with line ranges and metadata; a small tail joins the chunk before it."""
    content = F.col("content")
    lines = T.lines(content)
    ranged = units.hint("rebalance").withColumn(
        "_r", _range_udf(embedding_ranges, sizes)(_line_lengths(content, sizes.maximum))
    )

    def build(r: Column, i: Column) -> Column:
        tail = F.concat(F.lit("\n"), _pick(lines, r["tail_first"], r["tail_last"]))
        is_last = i == F.size("_r") - 1
        return F.struct(
            F.concat(
                _pick(lines, r["first"], r["last"]),
                F.when(r["tail_first"] >= 0, tail).otherwise(""),
            ).alias("content"),
            (F.col("line_start") + r["first"]).alias("start_line"),
            F.when(is_last, F.col("line_end")).otherwise(F.col("line_start") + r["last"])
            .alias("end_line"),
        )

    single = F.array(
        F.struct(content.alias("content"), F.col("line_start").alias("start_line"),
                 F.col("line_end").alias("end_line"))
    )
    many = F.length(content) > sizes.maximum
    context = (
        T.inline_header(F.col("signature"), F.col("qualified_name"), F.col("type"), F.col("docstring"))
        if include_context
        else F.lit("")
    )
    base = F.create_map(
        F.lit("name"), F.col("name"), F.lit("type"), F.col("type"), F.lit("file"), F.col("file_path")
    )
    numbered = F.map_concat(
        base, F.create_map(F.lit("chunk_index"), F.col("_i").cast("string"))
    )
    rows = ranged.withColumn("_c", F.when(many, F.transform("_r", build)).otherwise(single)).select(
        "*", F.posexplode("_c").alias("_i", "_chunk")
    )
    return rows.select(
        F.concat(F.col("id"), F.lit("::chunk_"), F.col("_i")).alias("id"),
        F.col("id").alias("unit_id"),
        F.col("_chunk.content").alias("content"),
        F.col("_chunk.start_line").alias("start_line"),
        F.col("_chunk.end_line").alias("end_line"),
        context.alias("context"),
        F.when(many, numbered).otherwise(base).alias("metadata"),
        T.content_hash(F.col("_chunk.content"), 16).alias("content_hash"),
    )
