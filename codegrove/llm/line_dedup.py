"""Fuzzy line deduplication by MinHash of character shingles.

A line's normal form is its text in lower case without white space at its ends. Lines without a word are kept as they are. Of all other
lines of all documents, one line of each class stays: the first by doc_id and place. Classes are the components of the links between
lines that are equal, or whose sets of seven-character shingles have a Jaccard index of 0.8 or more. Lines of fewer than seven
characters are only compared as a whole.

Signatures are minima of permuted shingle hashes; eight bands of four rows find a pair at the threshold with probability 0.985, at 0.85
with 0.997 and at 0.9 with 0.9998. Candidates are verified exactly (``neighbours``). Lines are found by a 64-bit key of their normal form.

The texts are read twice to find lines and buckets, and shuffled once, to be put together again; verification moves only lines
that are candidates.

Defined results: null texts stay null, empty ones empty. A document keeps its row even if no line of it stays. Rows repeated with
id and text are one document and keep the same lines. Rows with a null id come first in the order. Other columns are passed on; an
``n_chars`` column is set to the length of the new text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.llm import neighbours
from codegrove.staging import Stage


@dataclass(frozen=True)
class Settings:
    letters: int = 7
    similarity: float = 0.8
    bands: int = 8
    band: int = 4

    @property
    def multipliers(self) -> np.ndarray:
        drawn = A.mix(np.arange(1, self.bands * self.band + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (drawn >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@dataclass
class Lines:
    """Lines with a word of a chunk of lower-case texts: row, number in the row, byte range without outer white space, key."""

    row: np.ndarray
    number: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray


def find_lines(chunk: A.Chunk) -> Lines:
    breaks = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    np.cumsum(chunk.data == 10, out=breaks[1:])
    per_row = breaks[chunk.offsets[1:]] - breaks[chunk.offsets[:-1]] + 1
    first_line = np.cumsum(per_row) - per_row
    line_row = np.repeat(np.arange(chunk.rows), per_row)
    number = np.arange(len(line_row)) - np.repeat(first_line, per_row)
    word_starts, word_ends = chunk.words()
    # the line of a word: the lines of the rows before its row, and the breaks before it in its row
    of = np.repeat(first_line - breaks[chunk.offsets[:-1]], chunk.counts(word_starts)) + breaks[word_starts]
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, dtype=np.int64)
    tail = np.append(head[1:], len(of)) - 1 if len(of) else head
    own = of[head]
    starts, ends = word_starts[head], word_ends[tail]
    return Lines(line_row[own], number[own], starts, ends, chunk.hashes(starts, ends))


def _letters(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the chunk, and the code point at which each byte offset begins."""
    codes = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    at = np.append(0, np.cumsum((chunk.data & 0xC0) != 0x80))
    return codes, at


def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-letter shingles of letter ranges, range after range, and their number by range (none for short ones)."""
    size = len(codes) - k + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    # hashes of 1, 2, 4 ... letters, and of k as two overlapping ones
    h, have = codes.astype(np.uint64), 1
    while have < k:
        step = min(have, k - have)
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * have) + h[step:]
        have += step
    h = A.mix(h)
    counts = np.maximum(ends - starts - k + 1, 0)
    return h[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))], counts


def _signed(chunk: A.Chunk, lines: Lines, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct lines long enough for shingles, and their band hashes."""
    keys, first = np.unique(lines.keys, return_index=True)
    codes, at = _letters(chunk)
    grams, counts = _grams(codes, at[lines.starts[first]], at[lines.ends[first]], s.letters)
    long = counts > 0
    begin = (np.cumsum(counts) - counts)[long]
    bands = np.zeros((int(long.sum()), s.bands), dtype=np.uint64)
    if len(begin):
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for i, m in enumerate(s.multipliers):
            least = np.minimum.reduceat(short * m, begin).astype(np.uint64)
            bands[:, i // s.band] = A.mix(bands[:, i // s.band] ^ least ^ np.uint64(i + 1)) * np.uint64(0x2545F4914F6CDD1D)
    return keys[long], bands


def _gram_sets(texts: pa.Array, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of all distinct shingles of each text, and where each text's begin."""
    chunk = A.whole(texts)
    codes, at = _letters(chunk)
    grams, counts = _grams(codes, at[chunk.offsets[:-1]], at[chunk.offsets[1:]], letters)
    # text number and hash in one word sort fast: 2 ** 14 texts at most, 50 bits of hash
    if chunk.rows > 1 << 14:
        raise ValueError("too many texts at once")
    key = np.sort(np.repeat(np.arange(chunk.rows, dtype=np.uint64) << np.uint64(50), counts) | (grams >> np.uint64(14)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    of = (key >> np.uint64(50)).astype(np.int64)
    return of, key & np.uint64((1 << 50) - 1), np.searchsorted(of, np.arange(chunk.rows + 1))


def jaccard(left: pa.Array, right: pa.Array, letters: int, least: float = 0.0) -> np.ndarray:
    """Jaccard index of the shingle sets of each pair of lines; 0 where the sizes alone put it below ``least``."""
    both = pc.dictionary_encode(pa.chunked_array([left, right])).combine_chunks()
    _, grams, cuts = _gram_sets(both.dictionary.cast(pa.large_string()), letters)
    indices = np.asarray(both.indices)
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(indices[: len(left)].tolist(), indices[len(left) :].tolist())):
        a, b = grams[cuts[x] : cuts[x + 1]], grams[cuts[y] : cuts[y + 1]]
        # sets of too different a size cannot be similar
        if len(a) and len(b) and min(len(a), len(b)) >= least * max(len(a), len(b)):
            common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            out[i] = common / (len(a) + len(b) - common)
    return out


def _row_key():
    """Rows of one id and one text are one document."""
    return F.xxhash64("doc_id", "text")


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, number, key of every line that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                found = find_lines(chunk)
                at = pa.array(found.row + chunk.lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(found.number.astype(np.int32)), pa.array(found.keys.view(np.int64))],
                    ["doc_id", "row_key", "number", "key"],
                )

    rows = docs.select("doc_id", _row_key().alias("row_key"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key long, number int, key long")


def _bucket_rows(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                yield from neighbours.bucket_rows(*_signed(chunk, find_lines(chunk), s))

    return docs.select("text").mapInArrow(run, neighbours.BUCKETS)


def _texts(docs: DataFrame) -> DataFrame:
    """key, text of every line, in normal form; a line repeated in a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                found = find_lines(chunk)
                keys, first = np.unique(found.keys, return_index=True)
                starts, sizes = found.starts[first], (found.ends - found.starts)[first]
                offsets = np.append(0, np.cumsum(sizes))
                data = chunk.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(int(offsets[-1]))]
                own = pa.Array.from_buffers(
                    pa.string(), len(keys), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
                )
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), own], ["key", "text"])

    return docs.select("text").mapInArrow(run, "key long, text string")


def kept_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, row_key, number of the one line of each class that stays."""
    stage = Stage(docs.sparkSession, "line-dedup")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row_key", "number")
    first = stage.table(line_table(docs).groupBy("key").agg(F.min(place).alias("first")))

    def texts_of(keys: DataFrame, n: int) -> DataFrame:
        wanted = F.broadcast(keys) if n <= neighbours.SENT_KEYS else keys
        return _texts(docs).join(wanted, "key", "left_semi").dropDuplicates(["key"])

    def similar(left: pa.Array, right: pa.Array) -> np.ndarray:
        return jaccard(left, right, s.letters, s.similarity) >= s.similarity

    def counts(texts: pa.Array) -> np.ndarray:
        of, grams, _ = _gram_sets(texts, s.letters)
        return neighbours.count_places(len(texts), of, grams, np.ones(len(of)))

    roots = neighbours.classes(stage, _bucket_rows(docs, s), texts_of, similar, counts, s.similarity)
    roots, linked_keys = stage.put(roots)
    roots = F.broadcast(roots) if linked_keys["rows"] <= neighbours.SENT_KEYS else roots
    # lines without a similar one are alone in their class: only the others are grouped
    linked = first.join(roots, "key").groupBy("root").agg(F.min("first").alias("first"))
    alone = first.join(roots, "key", "left_anti")
    return linked.select("first.*").unionByName(alone.select("first.*")).drop("named")


def dedup_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs``, all columns and rows, with the lines of ``text`` that stay; plus ``n_lines`` and ``n_kept`` (lines with a word)."""
    columns = docs.columns
    key, numbers, lines, blank = (A.unused(columns, n) for n in ("row_key", "kept_numbers", "line_list", "blank_numbers"))
    kept = kept_lines(docs, s).groupBy(F.col("row_key").alias(key)).agg(F.collect_list("number").alias(numbers))
    marked = docs.withColumn(key, _row_key()).join(kept, key, "left").withColumn(lines, F.split("text", "\n"))
    none = F.array().cast("array<int>")
    marked = marked.withColumns({
        numbers: F.coalesce(numbers, none),
        blank: F.filter(F.transform(lines, lambda line, i: F.when(~line.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull()),
    })
    order = A.unused(columns, "line_order")
    marked = marked.withColumn(order, F.sort_array(F.concat(F.col(numbers), F.coalesce(blank, none))))
    out = marked.select(
        *[c for c in columns if c not in ("text", "n_chars")],
        F.array_join(F.transform(order, lambda i: F.get(F.col(lines), i)), "\n").alias("text"),
        (F.coalesce(F.size(lines) - F.size(blank), F.lit(0))).alias(A.unused(columns, "n_lines")),
        F.size(numbers).alias(A.unused(columns, "n_kept")),
        F.col("text").isNull().alias(A.unused(columns, "no_text")),
    )
    out = out.withColumn("text", F.when(~F.col(A.unused(columns, "no_text")), F.col("text"))).drop(A.unused(columns, "no_text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns, *[c for c in out.columns if c not in columns])
