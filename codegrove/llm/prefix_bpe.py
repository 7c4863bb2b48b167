"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a piece of bytes ends, for every prefix, in one token only that fits: the token before it, which is the last token of the
shorter prefix, may stand to its left. Storing this last token for each prefix makes a table that is filled from left to right in
one pass, read backwards for the ids, continued when bytes are appended, and repaired around an edit until it agrees with the old one.

Two tokens may stand side by side if byte-pair merging of their bytes gives just them. That is decided by taking their merges back,
latest first, and looking whether the parts then touching at the border would have merged earlier.

Texts are split by the vocabulary's pattern; each match is encoded separately. Words recur, so each task keeps a bounded memory of the
ids of matches it has seen. Decoding joins the bytes of the ids.

Defined results: a null text is empty; an empty text has no ids. Texts are encoded whole; special tokens are ordinary text. Bytes
outside UTF-8 cannot occur in a string column. Repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from codegrove.llm import arrays as A

#: Matches and token pairs that a task remembers before it starts again.
MEMORY = 1_000_000
#: Longer matches, in bytes, are not remembered.
LONG = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 tokens, one a line. The size of a vocabulary does not follow the data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain byte-pair merging: always the adjacent pair of the lowest rank. For short inputs and tests."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not options or (below is not None and min(options)[0] >= below):
            break
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Vocabulary:
    """Tokens, how each was merged, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.reach: dict[bytes, int] = {}  # last three bytes -> length of the longest token that ends so
        for token in ranks:
            if len(token) > 2:
                self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 0))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[bytes, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        if token not in self._halves:
            parts = merge_by_rank(self.bytes[token], self.ranks, below=token)
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def side_by_side(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMORY:
                self._pairs.clear()
            known = self._pairs[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # A merge across the border counts if it came before the merges taken back so far. Of equal ranks the left one is first.
        earlier_than, ties = None, False
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and (earlier_than is None or across < earlier_than or (ties and across == earlier_than)):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                earlier_than, ties, left = left, False, a[1]
            else:
                earlier_than, ties, right = right, True, b[0]

    def ids(self, pieces: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of at least the given matches; what is new is worked out in sorted order, so that equal prefixes are shared."""
        if len(self._known) >= MEMORY:
            self._known = {}
        known, table, before, whole = self._known, PrefixTable(self), b"", self.ranks.get
        for piece in sorted(set(pieces).difference(known)):
            token = whole(piece)
            if token is not None:
                known[piece] = (token,)
                continue
            shared, most = 0, min(len(before), len(piece))
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            table.cut(shared)
            table.append(piece[shared:])
            known[piece], before = tuple(table.ids()), piece
        return known


class PrefixTable:
    """The last token of every prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; nothing before them is computed again."""
        start = len(self.data)
        self.data += data
        self._fill(start + 1, len(self.data))

    def cut(self, size: int) -> None:
        """Keep the first ``size`` bytes."""
        self.data = self.data[:size]
        del self.last[size + 1 :]

    def _fill(self, first: int, final: int) -> None:
        """Last tokens of the prefixes ``first`` to ``final``: the longest that ends there and may follow what comes before it."""
        v, data, last = self.vocabulary, self.data, self.last
        token_of, fitting, reach = v.ranks.get, v._pairs.get, v.reach.get
        for end in range(first, final + 1):
            start = end - reach(data[end - 3 : end], 2) if end > 2 else 0
            if start < 0:
                start = 0
            while True:
                token = token_of(data[start:end])
                if token is not None:
                    if not start:
                        break
                    left = last[start]
                    fits = fitting((left, token))
                    if fits or (fits is None and v.side_by_side(left, token)):
                        break
                start += 1
                if start == end:
                    raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def replace(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace bytes; returns how many prefixes were computed again.

        A last token depends on its own bytes and on last tokens at most one token's length before it. Once as many
        prefixes behind the edit agree with the old table, the rest of the old table holds.
        """
        old, old_data = self.last, self.data
        self.data = old_data[:at] + inserted + old_data[at + removed :]
        self.last = old[: at + 1]
        shift, agreeing, end = len(inserted) - removed, 0, at
        while end < len(self.data):
            end += 1
            self._fill(end, end)
            token = self.last[end]
            behind = end - shift
            settled = end - at - len(inserted) >= self.vocabulary.longest
            agreeing = agreeing + 1 if end > at + len(inserted) and old[behind] == token else 0
            if settled and agreeing >= self.vocabulary.longest:
                self.last += old[behind + 1 :]
                break
        return end - at

    def ids(self) -> list[int]:
        out, end, last, size = [], len(self.data), self.last, self.vocabulary.sizes
        while end:
            token = last[end]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out


class TextEncoder:
    """Encodes texts match by match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        tokens = [self.vocabulary.bytes.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one entry more than texts)."""
        pieces = [list(map(str.encode, self.split(t))) for t in texts]
        together = list(chain.from_iterable(pieces))
        known = self.vocabulary.ids(together)
        found = list(map(known.__getitem__, together))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        ends = np.append(0, np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found))))
        for piece in together:
            if len(piece) > LONG:
                known.pop(piece, None)
        return ids, ends[np.append(0, np.cumsum([len(p) for p in pieces], dtype=np.int64))]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of ``text + more``, given those of ``text``: only its last match can change, as all others saw what follows them."""
        pieces = self.split(text)
        if not pieces:
            return self.encode(text + more)
        last = pieces[-1]
        return ids[: len(ids) - len(self.encode(last))] + self.encode(last + more)

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.asarray(ids, dtype=np.int32)).tobytes()

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        start, size = self._starts[ids], self._sizes[ids]
        end = np.cumsum(size)
        return self._bytes[np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


@dataclass(frozen=True)
class _Source:
    ranks: dict[bytes, int]
    pattern: str


_encoders: dict[int, TextEncoder] = {}


def _encoder(held) -> TextEncoder:
    """The encoder of this Python worker for a broadcast vocabulary."""
    if held.id not in _encoders:
        _encoders.clear()
        _encoders[held.id] = TextEncoder(held.value.ranks, held.value.pattern)
    return _encoders[held.id]


class _Held:
    def __init__(self, broadcast, number: int):
        self._broadcast, self.id = broadcast, number

    @property
    def value(self) -> _Source:
        return self._broadcast.value


def _hold(df: DataFrame, ranks: dict[bytes, int], pattern: str) -> _Held:
    context = df.sparkSession.sparkContext
    return _Held(context.broadcast(_Source(ranks, pattern)), hash((context.applicationId, pattern, len(ranks), sum(ranks.values()))))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row of ``docs`` (doc_id, text)."""
    held = _hold(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        for batch in batches:
            texts = A.text_column(batch)
            for chunk in A.chunks(texts):
                ids, offsets = encoder.encode_all(texts.slice(chunk.lo, chunk.rows).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, chunk.rows), lists], ["doc_id", "ids"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (binary) of every row of ``tokens`` (doc_id, ids)."""
    held = _hold(tokens, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column(1)
                ids = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int32)
                counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                bytes_to = np.append(0, np.cumsum(encoder._sizes[ids]))[np.append(0, np.cumsum(counts, dtype=np.int64))]
                decoded = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(bytes_to.astype(np.int32)), pa.py_buffer(encoder.decode_all(ids))]
                )
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], ["doc_id", "ids", "decoded"])

    narrow = tokens.select("doc_id", "ids")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
