"""Best-fit packing by exact complements.

Token sequences hold at most ``size`` tokens. Pieces of documents are packed by length alone: a histogram of lengths (at most ``size``
counts, however large the table) is planned on the driver, and every piece finds its place by its rank among the pieces of its length.

The plan takes the longest pieces first. What is missing to ``size`` is looked up in the sums of one, two and three lengths that are
still available; a combination that fills the gap exactly is used as often as its counts allow. What no combination completes is
packed best-fit, longest first, many equal sequences at a time.

Ranks need no global order: tokenizing counts the pieces of each length in its own task, and the tasks' counts are summed up.

Defined results: a null text is empty; an empty document is one piece that holds the end token only. Repeated rows are packed each on
its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.staging import Stage

#: Letters and signs for which the two tokenizer libraries are known to split alike; other texts take the slower one.
_PLAIN = re.compile(r"[^\x00-ɏ‐-‧€]")


class Tokenizer:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Where the ids follow the order of the merges, ranks and ids are one, and texts in common letters without an added token are encoded by
    the faster ``tiktoken``, with the same result.
    """

    def __init__(self, definition: str, pattern: str):
        import tiktoken
        import tokenizers

        self._slow = tokenizers.Tokenizer.from_str(definition)
        parsed = json.loads(definition)
        self._added = [t["content"] for t in parsed.get("added_tokens", [])]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = parsed["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
        order = [vocabulary["".join(m)] for m in merges]
        self._fast = None
        if order == sorted(order) and (parsed.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in self._added}
            self._fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self._fast is None or _PLAIN.search(text) or any(t in text for t in self._added):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


@dataclass(frozen=True)
class Packed:
    """``pieces``: doc_id, piece, start, length, sequence_id, offset, task, row. ``tokens``: task, row, ids (little-endian 32-bit)."""

    pieces: DataFrame
    tokens: DataFrame

    def sequences(self) -> DataFrame:
        """``sequence_id`` and ``ids`` (binary) of every sequence, at most ``size`` tokens each."""
        part = F.struct("offset", "ids")
        parts = self.pieces.join(self.tokens, ["task", "row"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
        joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
        return parts.select("sequence_id", joined.alias("ids"))


def cut(count: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``count`` tokens: full ones, but for the first, which may be shorter."""
    first = count % size or size
    return [(0, min(first, count))] + [(s, size) for s in range(first, count, size)]


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such). Their sums are at most ``size``; all counts are used up."""
    left = {n: c for n, c in counts.items() if c > 0}
    done: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> int:
        """How often the lengths are available together."""
        return min(left.get(n, 0) // lengths.count(n) for n in set(lengths))

    def best(options: Iterator[tuple[int, ...]], longest: int) -> tuple[int, tuple[int, ...]]:
        return max(((use((longest, *o)), o) for o in options), default=(0, ()))

    def pairs(total: int) -> Iterator[tuple[int, ...]]:
        return ((a, total - a) for a in range((total + 1) // 2, total) if a in left and total - a in left)

    for longest in sorted(left, reverse=True):
        gap = size - longest
        searches = (
            lambda: iter([()] if gap == 0 else []),
            lambda: iter([(gap,)] if gap in left else []),
            lambda: pairs(gap),
            lambda: ((a, *p) for a in sorted(left, reverse=True) if 3 * a >= gap > a for p in pairs(gap - a) if p[0] <= a),
        )
        for search in searches:
            while left.get(longest):
                times, others = best(search(), longest)
                if not times:
                    break
                done.append(((longest, *others), times))
                for n in (longest, *others):
                    left[n] -= times
                    if not left[n]:
                        del left[n]
    # the rest: best fit, equal sequences together. open: free room -> [lengths, how many]
    room: dict[int, list[list]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            fit = min((r for r, g in room.items() if r >= n and g), default=None)
            if fit is None:
                each = size // n
                whole, c = divmod(c, each)
                if whole:
                    room[size - each * n].append([(n,) * each, whole])
                if c:
                    room[size - c * n].append([(n,) * c, 1])
                break
            lengths, copies = room[fit].pop()
            fill = fit // n
            used = min(copies, c // fill)
            if used:
                room[fit - fill * n].append([lengths + (n,) * fill, used])
                c -= used * fill
            else:
                used = 1
                room[fit - c * n].append([lengths + (n,) * c, 1])
                c = 0
            if copies > used:
                room[fit].append([lengths, copies - used])
    return done + [(tuple(g), k) for groups in room.values() for g, k in groups]


def _slots(sequences: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, ...]]:
    """(length, first rank, last rank, sequence of the first rank, offset, pieces side by side): which ranks of a length go where."""
    ranks: dict[int, int] = defaultdict(int)
    out, number = [], 0
    for lengths, copies in sequences:
        offset = 0
        for n, run in groupby(lengths):
            side = len(list(run))
            out.append((n, ranks[n], ranks[n] + copies * side - 1, number, offset, side))
            ranks[n] += copies * side
            offset += n * side
        number += copies
    return out


def tokenize(docs: DataFrame, definition: str, pattern: str, end_id: int, size: int) -> DataFrame:
    """Pieces of every document with their ids, and each piece's rank among those of its length in its task."""
    held = docs.sparkSession.sparkContext.broadcast((definition, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(*held.value)
        task, row, seen = TaskContext.get().partitionId(), 0, [0] * (size + 1)
        for batch in batches:
            texts = A.text_column(batch)
            for chunk in A.chunks(texts):
                of, columns, ids = [], [], []
                for i, text in enumerate(texts.slice(chunk.lo, chunk.rows).to_pylist()):
                    own = np.append(tokenizer.encode(text), np.uint32(end_id)).astype("<u4")
                    for nth, (start, length) in enumerate(cut(len(own), size)):
                        of.append(chunk.lo + i)
                        columns.append((nth, start, length, task, row, seen[length]))
                        ids.append(own[start : start + length].tobytes())
                        seen[length] += 1
                        row += 1
                numbers = np.array(columns, dtype=np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), pa.array(numbers[:, 0].astype(np.int32))]
                    + [pa.array(numbers[:, k].copy()) for k in range(1, 6)] + [pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "task", "row", "nth", "ids"],
                )

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, task long, row long, nth long, ids binary"
    )


def pack(docs: DataFrame, definition: str, pattern: str, end_id: int = 2, size: int = 1024) -> Packed:
    """Pack all ``docs`` (doc_id, text). ``definition``: the JSON of a byte-level BPE tokenizer; ``pattern``: its split pattern."""
    spark = docs.sparkSession
    # the pieces are written once: ranks counted in a task hold only for the rows that this very task wrote
    pieces = Stage(spark, "packing").table(tokenize(docs, definition, pattern, end_id, size))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(plan(histogram, size)) or [(0, 0, -1, 0, 0, 1)],
        "slot_length long, lo long, hi long, sequence long, at long, side long",
    )
    by_task = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("base"))
    ranked = (
        pieces.select("doc_id", "piece", "start", "length", "task", "row", "nth")
        .join(bases, ["task", "length"])
        .withColumn("rank", F.col("base") + F.col("nth"))
    )
    # the plan has a few thousand rows at most: each step uses up one of ``size`` lengths
    placed = ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("lo"), F.col("hi"))
    )
    nth = F.col("rank") - F.col("lo")
    return Packed(
        placed.select(
            "doc_id", "piece", "start", "length",
            (F.col("sequence") + F.floor(nth / F.col("side"))).alias("sequence_id"),
            (F.col("at") + F.pmod(nth, F.col("side")) * F.col("length")).alias("offset"), "task", "row",
        ),
        pieces.select("task", "row", "ids"),
    )
