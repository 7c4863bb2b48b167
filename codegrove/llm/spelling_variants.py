"""Spelling variants of words, by PartEnum signatures of their letters.

Two words are near if they differ by one inserted, deleted or replaced letter. Taken as a multiset of letters, that is a binary vector (one place
for each letter and how often it came before), such words have a Hamming distance of two at most. PartEnum finds all pairs within that distance
exactly: the alphabet is split into ``parts`` of about equal weight, a signature leaves out two of them, and as two differences touch two parts
at most, near words agree in a signature. Signatures are equi-joined and each pair is verified by its edit distance.

Words made of the same syllables have the same letters, so letters alone would give more pairs than words squared allow at scale. A
signature therefore also carries an untouched half: the difference lies in one half of the words, the other half is equal. Halves are of
k letters, k half of the shorter word's length; a word of even length also gives signatures for k - 1, for pairs in which it is the longer one.
No pair is lost by that. The join is a plain self-join by signature with a shuffle that both sides share; Spark splits and spills skewed
signatures, and only verified pairs leave the join.

Words come from whole texts, in tasks, counted before they are sent. The written form of a word is changed in one of ``period`` of the
cases (by the checksum of id and word), which stands for misspellings.

Null texts have no words; a null id is written as an empty one; repeated rows count each time; ties of counts go to the smaller word; empty tables
give an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.staging import Stage

#: Words that are collected in a task before they are counted and sent.
COUNTED = 400_000
#: Runs of more bytes are checksummed one by one.
LONG = 64


@dataclass(frozen=True)
class Settings:
    """Words of ``letters`` or more, seen ``least`` times; a form is ``ratio`` times as frequent; ``period`` of the changes; ``parts`` of the alphabet."""

    letters: int = 7
    least: int = 2
    ratio: int = 10
    period: int = 31
    parts: int = 4

    def __post_init__(self):
        if self.parts < 3 or self.letters < 2:
            raise ValueError("three parts and two letters at least")


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Checksum of each byte range, continued from ``before``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state = (~before.astype(np.uint32))[order]
    at, size = starts[order], size[order]
    whole = int(np.searchsorted(-size, -LONG, side="left"))
    for i in range(whole):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~state[i])))
    state, done = state[whole:], state[:whole]
    at, size = at[whole:], size[whole:]
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -j, side="left"))
        state[:n] = _TABLE[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = ~np.append(done, state)
    return out


def letter_runs(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of runs of letters (A-Z, a-z, U+00C0 to U+00FF) and their numbers of letters."""
    data = chunk.data
    lead = data == 0xC3
    inside = lead.copy()
    inside[1:] |= lead[:-1]
    lower = data | 32
    inside |= (lower >= 97) & (lower <= 122)
    starts, ends = A.runs(inside, chunk.offsets)
    two = np.append(0, np.cumsum(lead))
    return starts, ends, ends - starts - (two[ends] - two[starts])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges, ascending and apart, as strings."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    own = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(own))


def _chunk_words(chunk: A.Chunk, ids: list[str], s: Settings) -> list[pa.Array]:
    starts, ends, letters = letter_runs(chunk)
    keep = letters >= s.letters
    starts, ends, letters = starts[keep], ends[keep], letters[keep]
    if not len(starts):
        return []
    upper = (chunk.data >= 65) & (chunk.data <= 90)
    data = np.where(upper, chunk.data + np.uint8(32), chunk.data)
    begins = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    h = crc32(data, starts, ends, begins[chunk.row_of(starts)]).astype(np.int64)
    changed = h % s.period == 0
    own = changed & (letters > s.letters)
    less = []
    for a, b, x, n in zip(starts[own].tolist(), ends[own].tolist(), h[own].tolist(), letters[own].tolist()):
        word = data[a:b].tobytes().decode()
        less.append(word[: x % n] + word[x % n + 1 :])
    return [gathered(data, starts[~changed], ends[~changed]), pa.array(less, pa.large_string())]


def words(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, n: the words of ``docs`` (doc_id, text) that come ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs = pc.value_counts(pa.concat_arrays(held))
            return pa.RecordBatch.from_arrays([pairs.field(0).cast(pa.string()), pairs.field(1)], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in A.chunks(A.text_column(batch)):
                found = _chunk_words(chunk, ids[chunk.lo : chunk.hi], s)
                held += found
                size += sum(map(len, found))
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").filter(F.col("text").isNotNull())
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.least)


def parts_of_alphabet(found: DataFrame, s: Settings) -> dict[int, int]:
    """Code point -> part. Letters are dealt to the lightest part, the most frequent first; there are 116 at most."""
    letter = F.explode(F.split("word", "")).alias("letter")
    counts = found.select(letter).filter("letter <> ''").groupBy("letter").count().collect()
    load, out = [0] * s.parts, {}
    for row in sorted(counts, key=lambda r: (-r["count"], r["letter"])):
        least = min(range(s.parts), key=lambda i: (load[i], i))
        out[ord(row["letter"])] = least
        load[least] += row["count"]
    return out


def signatures(texts: pa.Array, parts: dict[int, int], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each word its signatures: index of the word, 64-bit signature."""
    chunk = A.whole(texts.cast(pa.large_string()))
    begins = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    places = np.append(begins, len(chunk.data))
    wide = chunk.data[begins].astype(np.int64)
    two = wide >= 0xC0
    code = wide.copy()
    code[two] = ((wide[two] & 31) << 6) | (chunk.data[begins[two] + 1] & 63)
    of_code = np.zeros(256, dtype=np.int64)
    of_code[list(parts)] = list(parts.values())
    value = A.mix(code.astype(np.uint64) + np.uint64(0x51ED27))
    first = np.searchsorted(begins, chunk.offsets)
    length = np.diff(first)
    sums = []
    for p in range(s.parts):
        total = np.append(np.uint64(0), np.cumsum(np.where(of_code[code] == p, value, np.uint64(0)), dtype=np.uint64))
        sums.append(total[first[1:]] - total[first[:-1]])
    every = sum(sums[1:], sums[0])
    # (words, k): half of the length, and one less where the length is even
    half = length // 2
    even = np.flatnonzero(length % 2 == 0)
    at = np.append(np.arange(len(length)), even)
    k = np.append(half, half[even] - 1)
    index, out = [], []
    starts, ends = first[:-1][at], first[1:][at]
    for side, lo, hi in ((1, places[starts], places[starts + k]), (2, places[ends - k], places[ends])):
        fixed = A.mix(chunk.hashes(lo, hi) + k.astype(np.uint64) * np.uint64(4) + np.uint64(side))
        for number, (i, j) in enumerate(combinations(range(s.parts), 2)):
            rest = (every - sums[i] - sums[j])[at]
            out.append(A.mix(fixed + A.mix(rest + np.uint64(number + 1))))
            index.append(at)
    return np.concatenate(index), np.concatenate(out)


def near_pairs(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, n, other, other_n of all pairs of near words in ``found`` (word, n), word before other."""
    parts = parts_of_alphabet(found, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 5000):
                part = batch.slice(base, 5000)
                index, signature = signatures(part.column(0), parts, s)
                rows = pa.array(index)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signature.view(np.int64)), part.column(0).take(rows), part.column(1).take(rows)], ["signature", "word", "n"]
                )

    signed = found.select("word", "n").mapInArrow(run, "signature long, word string, n long")
    a, b = signed.alias("a"), signed.alias("b")
    apart = F.abs(F.length("a.word") - F.length("b.word")) <= 1
    one_edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    joined = a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("a.word") < F.col("b.word")) & apart & one_edit)
    return joined.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()


def variants(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words in ``found`` (word, n)."""
    stage = Stage(found.sparkSession, "spelling-variants")
    found = stage.table(found)
    pairs = stage.table(near_pairs(found, s))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best")
    per_word = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.minus") >= s.ratio * F.col("n")
    per_word = stage.table(per_word.select(
        "word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
    ))
    # each round doubles the steps that a word has gone; a form is ``ratio`` times as frequent as its word, so few are needed
    roots, seen = stage.put(per_word.filter("form is not null").select("word", F.col("form").alias("root")))
    while seen["rows"]:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = roots.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        roots, seen = stage.put(moved, moving=F.count_if("moved"))
        roots = roots.select("word", "root")
        if not seen["moving"]:
            break
    return (
        found.join(per_word, "word", "left").join(roots, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )
