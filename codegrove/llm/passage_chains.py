"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are runs of five words, thinned to the least hash of every window of twelve (a winnowing scheme): two texts that share sixteen words
in a row share a seed there. Documents are ordered by doc_id. An occurrence of a seed is matched with earlier documents that have it: with
the first and the three before it in its chunk of a task, or, if it is the first there, with the first of all and the three before it. So a
passage shared by n documents costs 4n matches, and a frequent one is sent on once per chunk, not once per document.

The matches of two documents are chained: a chain is a series of matches that goes forward in both, its score the words it covers less a
cost for every word skipped. The best chain that ends at a match is found with a Fenwick tree over places in the other document (maxima of
prefixes, as the gap cost splits into a term of either end). Chains are read off from the best end down, no match is used twice.

The two stretches of each chain are cut out of their texts with a margin, extended over words that are alike (others may lie between them, see
``extend``), and aligned by their longest common subsequence of words; chains inside a verbatim repeat are not. A passage is reported if it has ``least`` words or more and the common words are 0.8 of the longer stretch. A chain that
is less similar is cut at its widest gap, and its parts are aligned in the same way.

Verbatim repeats do not depend on which occurrences were matched: a repeat of ``least`` words is covered by seeds that occur elsewhere too, at
most ``window`` words apart. All runs of ``least`` words in such stretches are compared by hash over all documents, each with the first place that
has it, or with the place before it in the same document. Those that no chain has reported are passages as well. Of a frequent run each chunk
sends on one row.

Nothing is left to which occurrences a frequent seed was matched with: two seeds of a text at most ``gap`` words apart are a link. Links outside all passages
found so far meet the same links of all earlier places (see ``_open_matches``). As ``extend`` gives up after a few unlike words, the words
next to a link tell for most pairs that no passage can come of it; the others are matches, chained and aligned as above. So a place that shares a link and a
passage with any earlier place is reported, with those of the earlier places that were compared.

Exact copies are one text: they are compared through the copy of the least id, and each other copy is one passage, its whole text.

Defined results: words are runs of anything but ASCII white space, in lower case. Null, empty and short texts give no rows. Within a document, later
passages are matched with earlier ones of the same document too. Rows with a null id take no part. Of rows that share an id but not the
text, each is a document of its own, named by the id. Rows repeated with id and text are one document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegrove.llm import arrays as A
from codegrove.llm.neighbours import SENT_KEYS
from codegrove.staging import Stage


@dataclass(frozen=True)
class Settings:
    words: int = 5  # of a seed
    window: int = 12  # seeds of which the least is kept
    least: int = 50  # words of a passage
    similarity: float = 0.8
    gap_cost: float = 0.2  # for each word skipped in either text
    gap: int = 40  # words that may lie between two matches of a chain
    margin: int = 64  # words beside a chain that the alignment may add
    drop: float = 16.0  # fall of the sum of equal and other words at which an extension ends


def seeds(chunk: A.Chunk, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, hash) of the thinned seeds."""
    starts, ends = chunk.words()
    counts = chunk.counts(starts)
    h, own = A.shingles(chunk.hashes(starts, ends), counts, s.words)
    row = np.repeat(np.arange(chunk.rows), own)
    number = np.arange(len(h)) - np.repeat(np.cumsum(own) - own, own)
    whole = np.repeat(counts >= s.words, own)
    row, number, h = row[whole], number[whole], h[whole]
    n = len(h)
    if n == 0:
        return row, number, h
    # least of each window that lies within a row; rows shorter than a window are one window
    chosen = np.zeros(n, dtype=bool)
    if n >= s.window:
        views = np.lib.stride_tricks.sliding_window_view(h, s.window)
        at = np.arange(len(views)) + views.argmin(1)
        inside = row[s.window - 1 :] == row[: n - s.window + 1]
        chosen[at[inside]] = True
    size = np.bincount(row, minlength=chunk.rows)
    first = np.cumsum(size) - size
    for r in np.flatnonzero((size > 0) & (size < s.window)):
        chosen[first[r] + h[first[r] : first[r] + size[r]].argmin()] = True
    return row[chosen], number[chosen], h[chosen]


def chains(x: np.ndarray, y: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Chains of matches (x: word in the later text, y: in the earlier one), as lists of match numbers, best first."""
    order = np.lexsort((-y, x))  # of equal x only one may be in a chain: the larger y come first and cannot follow each other
    xs, ys = x[order].tolist(), y[order].tolist()
    ranks = np.unique(y)
    rank = (np.searchsorted(ranks, y[order]) + 1).tolist()
    n, size, words, gap_cost = len(xs), len(ranks), s.words, s.gap_cost
    tree_value, tree_at = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back, reach = [0.0] * n, [-1] * n, [0.0] * n
    top, top_at, top_rank, filed = float("-inf"), -1, size + 1, 0
    for i in range(n):
        # the best chain end with smaller x and y, its cost being counted from its own end: the best of all, if its y is smaller
        r, at = rank[i], top_at
        if top_rank >= r:
            for j in range(filed, i):
                value, k = reach[j], rank[j]
                # a node that holds more has only nodes above it that hold more
                while k <= size and value > tree_value[k]:
                    tree_value[k], tree_at[k] = value, j
                    k += k & -k
            filed = i
            value, at, k = float("-inf"), -1, r - 1
            while k > 0:
                if tree_value[k] > value:
                    value, at = tree_value[k], tree_at[k]
                k -= k & -k
        own = float(words)
        if at >= 0:
            dx, dy = xs[i] - xs[at], ys[i] - ys[at]
            linked = score[at] + (dx if dx < dy else dy) if dx < words or dy < words else score[at] + words
            if dx > words:
                linked -= gap_cost * (dx - words)
            if dy > words:
                linked -= gap_cost * (dy - words)
            if linked > own:
                own, back[i] = linked, at
        score[i] = own
        reach[i] = value = own + gap_cost * (xs[i] + ys[i])
        if value > top:
            top, top_at, top_rank = value, i, r
    used, out = [False] * n, []
    for i in sorted(range(n), key=score.__getitem__, reverse=True):
        if used[i]:
            continue
        path, k = [], i
        while k >= 0 and not used[k]:
            used[k] = True
            path.append(k)
            k = back[k]
        at = order[path[::-1]]
        if len(path) > 1:
            # a chain bridges a wide gap if what follows is worth it; its parts are passages of their own
            wide = np.flatnonzero(np.maximum(np.diff(x[at]), np.diff(y[at])) > s.gap + s.words) + 1
            out += np.split(at, wide) if len(wide) else [at]
        else:
            out.append(at)
    return out


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def extend(a: list[int], i: int, b: list[int], k: int, step: int, cost: float, s: Settings) -> tuple[int, int]:
    """Places up to which words at ``a[i]`` and ``b[k]`` go on to be alike (``step`` 1: forwards, -1: the words before them, backwards).

    An equal word counts one, another takes ``cost`` away. Words replaced, left out or put in are stepped over where two equal words follow. The walk ends when the sum has fallen ``drop`` below its best.
    """
    p, q = (a[i:], b[k:]) if step > 0 else (a[:i][::-1], b[:k][::-1])
    n, m = len(p), len(q)
    p += [None] * 3  # past the ends nothing is equal
    q += [-1.5] * 3
    x = y = best_x = best_y = 0
    total = best = 0.0
    while total > best - s.drop and x < n and y < m:
        if p[x] == q[y]:
            x, y, total = x + 1, y + 1, total + 1
            if total > best:
                best, best_x, best_y = total, x, y
            continue
        for dx, dy in ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1)):
            if p[x + dx] == q[y + dy] and x + dx < n and y + dy < m and p[x + dx + 1] == q[y + dy + 1]:
                break
        else:
            dx = dy = 1
        total -= cost * max(dx, dy)
        x, y = x + dx, y + dy
    return i + step * best_x, k + step * best_y


def align(a: list[int], a_at: tuple[int, int], b: list[int], b_at: tuple[int, int], s: Settings) -> tuple[int, int, int, int, float]:
    """Stretches of two word lists, extended over words alike on both sides, and their similarity (0 if the first has less than ``least`` words).

    The extension is generous first; if that is not similar enough, another word costs what equal words of a passage must make up for, so that
    nothing added makes a passage less similar than asked.
    """
    strict = s.similarity / (1 - s.similarity)
    found = (*a_at, *b_at, 0.0)
    for cost in (strict / 2, strict):
        i, k = extend(a, a_at[0], b, b_at[0], -1, cost, s)
        j, m = extend(a, a_at[1], b, b_at[1], 1, cost, s)
        if j - i < s.least:
            break
        found = i, j, k, m, common_words(a[i:j], b[k:m]) / max(j - i, m - k)
        if found[4] >= s.similarity:
            break
    return found


def similar_parts(a: list[int], xs: list[int], b: list[int], ys: list[int], s: Settings) -> Iterator[tuple[int, int, int, int, float]]:
    """Passages of a chain of matches (``xs`` in ``a``, ``ys`` in ``b``): the whole, or else those of its parts on either side of its widest gap."""
    open_parts = [(0, len(xs))]
    while open_parts:
        p, q = open_parts.pop()
        found = align(a, (xs[p], xs[q - 1] + s.words), b, (ys[p], ys[q - 1] + s.words), s)
        if found[1] - found[0] >= s.least and found[4] >= s.similarity:
            yield found
        elif q - p > 1:
            cut = max(range(p + 1, q), key=lambda c: max(xs[c] - xs[c - 1], ys[c] - ys[c - 1]))
            open_parts += [(p, cut), (cut, q)]


def row_key():
    """Rows of one id and one text are one document."""
    return F.xxhash64("doc_id", "text")


_SEED, _MATCH = 0, 1
#: Occurrences just before an occurrence with which it is matched, besides the first.
BEFORE = 3


def _matches_of(first: np.ndarray, at: np.ndarray, key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, word, other key, other word) of occurrences ``at``, each with the first of its run and with the ``BEFORE`` before it."""
    backs = [at[at - back > first[at]] for back in range(1, BEFORE + 1)]
    later = np.concatenate([at, *backs])
    other = np.concatenate([first[at], *(own - back for back, own in enumerate(backs, 1))])
    real = (key[later] != key[other]) | (word[later] != word[other])
    later, other = later[real], other[real]
    return key[later], word[later], key[other], word[other]


def _rows(kind: int, seed: np.ndarray, ids: pa.Array, key, word, other, other_word) -> pa.RecordBatch:
    # matches are dealt out by document, so that those of a frequent seed do not meet
    deal = seed if kind == _SEED else A.mix(key.view(np.uint64)).view(np.int64)
    columns = [pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(deal), ids]
    columns += [pa.array(key), pa.array(word.astype(np.int32)), pa.array(other), pa.array(other_word.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "deal", "doc_id", "key", "word", "other", "other_word"])


def _seed_rows(texts: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(1).to_numpy(), batch.column(0)
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                own = ids.slice(chunk.lo, chunk.rows)
                rank = np.empty(chunk.rows, dtype=np.int64)
                named = pa.table({"i": own, "k": pa.array(keys[chunk.lo : chunk.hi])})
                order = np.asarray(pc.sort_indices(named, sort_keys=[("i", "ascending"), ("k", "ascending")]))
                rank[order] = np.arange(chunk.rows)
                row, word, seed = seeds(chunk, s)
                order = np.lexsort((word, rank[row], seed))
                row, word, seed = row[order], word[order], seed[order].view(np.int64)
                if not len(row):
                    continue
                key = keys[chunk.lo : chunk.hi][row]
                head = np.append(True, seed[1:] != seed[:-1])
                first = np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
                at = np.flatnonzero(head)
                yield _rows(_SEED, seed[at], own.take(pa.array(row[at])), key[at], word[at], key[at], word[at])
                k, x, other, y = _matches_of(first, np.flatnonzero(~head), key, word)
                if len(k):
                    yield _rows(_MATCH, k, pa.nulls(len(k), own.type), k, x, other, y)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "key", "text").mapInArrow(
        run, f"kind int, deal long, doc_id {kind}, key long, word int, other long, other_word int"
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches from rows sorted by seed and document; the first and the last rows of a seed in progress are carried along."""
    none = np.zeros(0, dtype=np.int64)
    seed, key, word = none, none, none
    names = ["key", "word", "other", "other_word"]
    for batch in batches:
        match = batch.column(0).to_numpy() == _MATCH
        if match.any():
            passed = batch.filter(pa.array(match))
            yield pa.RecordBatch.from_arrays([passed.column(i) for i in (3, 4, 5, 6)], names)
        new = [batch.column(i).to_numpy()[~match].astype(np.int64) for i in (1, 3, 4)]
        if not len(new[0]):
            continue
        old = len(seed)
        seed, key, word = (np.append(a, b) for a, b in zip((seed, key, word), new))
        head = np.append(True, seed[1:] != seed[:-1])
        first = np.maximum.accumulate(np.where(head, np.arange(len(seed)), 0))
        at = np.flatnonzero(~head & (np.arange(len(seed)) >= old))
        k, x, other, y = _matches_of(first, at, key, word)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x.astype(np.int32)), pa.array(other), pa.array(y.astype(np.int32))], names)
        ends = np.unique(np.append(first[-1], np.arange(max(first[-1], len(seed) - BEFORE), len(seed))))
        seed, key, word = seed[ends], key[ends], word[ends]


_CHAINED = {"key": pa.int64(), "x0": pa.int64(), "x1": pa.int64(), "other": pa.int64(), "y0": pa.int64(), "y1": pa.int64(), "xs": pa.list_(pa.int32()), "ys": pa.list_(pa.int32())}


def _chained(key, x0, x1, other, y0, y1, xs: pa.Array, ys: pa.Array) -> pa.RecordBatch:
    columns = [pa.nulls(len(xs), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (key, x0, x1, other, y0, y1)]
    return pa.RecordBatch.from_arrays([*columns, xs, ys], list(_CHAINED))


def _lists(first: np.ndarray, last: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of the values at ``first`` to ``last`` (inclusive)."""
    size = last - first + 1
    offsets = np.append(0, np.cumsum(size))
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[at].astype(np.int32)))


def _chain_pairs(key: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows of ``_chain_up`` for whole pairs.

    Where all matches of a pair go forward in both documents and each is worth more than the words skipped before it, the best chain
    holds them all: the one before is then the best to follow, as scores and places both grow. Other pairs need the search of ``chains``.
    """
    order = np.lexsort((-y, x, other, key))
    key, other, x, y = key[order], other[order], x[order], y[order]
    n = len(key)
    same = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
    head = np.flatnonzero(np.append(True, ~same))
    tail = np.append(head[1:], n) - 1
    dx, dy = np.diff(x), np.diff(y)
    skipped = np.maximum(dx - s.words, 0) + np.maximum(dy - s.words, 0)
    forward = (dx > 0) & (dy > 0) & (np.minimum(np.minimum(dx, dy), s.words) - s.gap_cost * skipped > 1e-6)
    simple = np.logical_and.reduceat(np.append(True, forward | ~same), head)
    a, b = head[simple], tail[simple]
    if len(a):
        yield _chained(key[a], None, None, other[a], None, None, _lists(a, b, x), _lists(a, b, y))
        # a wide gap ends a part
        wide = np.append(True, ~same | (np.maximum(dx, dy) > s.gap + s.words))
        first = np.flatnonzero(wide)
        last = np.append(first[1:], n) - 1
        good = np.repeat(simple, tail - head + 1)[first] & (last > first)
        c, d = first[good], last[good]
        if len(c):
            yield _chained(key[c], x[c], x[d] + s.words, other[c], y[c], y[d] + s.words, _lists(c, d, x), _lists(c, d, y))
    found = []
    for i, j in zip(head[~simple].tolist(), (tail[~simple] + 1).tolist()):
        k, o, xs, ys = int(key[i]), int(other[i]), x[i:j], y[i:j]
        found.append((k, None, None, o, None, None, np.unique(xs), np.unique(ys)))
        for path in chains(xs, ys, s):
            if len(path) > 1:
                found.append((k, int(xs[path[0]]), int(xs[path[-1]]) + s.words, o, int(ys[path[0]]), int(ys[path[-1]]) + s.words, xs[path], ys[path]))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _CHAINED.values())], list(_CHAINED))


def _chain_up(s: Settings):
    """Chains from matches sorted by the two documents, and for each two documents the words of their matches (a row without a chain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in range(4)]
        for batch in batches:
            new = [batch.column(i).to_numpy().astype(np.int64) for i in (0, 2, 1, 3)]
            if not batch.num_rows:
                continue
            # the pair in progress stays behind; its parts are put together once
            ends = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if not cut and held[0] and (held[0][-1][-1], held[1][-1][-1]) != (new[0][-1], new[1][-1]):
                yield from _chain_pairs(*(np.concatenate(h) for h in held), s)
                held = [[] for _ in range(4)]
            if cut:
                yield from _chain_pairs(*(np.concatenate([*h, c[:cut]]) for h, c in zip(held, new)), s)
                held = [[] for _ in range(4)]
            for h, c in zip(held, new):
                h.append(c[cut:])
        if held[0]:
            yield from _chain_pairs(*(np.concatenate(h) for h in held), s)

    return run


def _suspects(s: Settings):
    """key, lo, hi (lists of word numbers) of the stretches that may hold a verbatim repeat, from (key, word) of the seeds that occur
    elsewhere too, sorted. All thinned seeds of the windows inside a repeat occur elsewhere, none more than a window from the next."""
    least = s.least - s.words - 2 * (s.window - 1)

    def of_key(key: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (word[1:] - word[:-1] > s.window)))
        tail = np.append(head[1:], len(key)) - 1
        good = word[tail] - word[head] >= least
        head, tail = head[good], tail[good]
        lo, hi = np.maximum(word[head] - (s.window - 1), 0), word[tail] + s.words + s.window - 1
        own = np.flatnonzero(np.append(True, key[head][1:] != key[head][:-1])) if len(head) else head
        offsets = pa.array(np.append(own, len(head)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (lo, hi)]
        return pa.RecordBatch.from_arrays([pa.array(key[head][own]), *lists], ["key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = word = np.zeros(0, dtype=np.int64)
        for batch in batches:
            key, word = (np.append(h, batch.column(i).to_numpy().astype(np.int64)) for i, h in enumerate((key, word)))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield of_key(key[:cut], word[:cut])
            key, word = key[cut:], word[cut:]
        if len(key):
            yield of_key(key, word)

    return run


_PLACE = ["kind", "deal", "doc_id", "key", "word", "other_doc_id", "other", "other_word"]


def _before(run: np.ndarray, key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places sorted by run and document: those with another one before them in their run, and that one (the last of the same document,
    else the first of all)."""
    n = len(run)
    head = np.append(True, run[1:] != run[:-1])[:n]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else head.astype(np.int64)
    at = np.flatnonzero(~head)
    other = np.where(key[at - 1] == key[at], at - 1, first[at])
    # the same document may come twice
    real = (key[other] != key[at]) | (word[other] != word[at])
    return at[real], other[real]


def _run_rows(rows: DataFrame, s: Settings) -> DataFrame:
    """Runs of ``least`` words of the suspect stretches: one place of each in a chunk, and the places that have an earlier one in their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                own = ids.slice(chunk.lo, chunk.rows)
                rank = np.empty(chunk.rows, dtype=np.int64)
                named = pa.table({"i": own, "k": pa.array(keys[chunk.lo : chunk.hi])})
                order = np.asarray(pc.sort_indices(named, sort_keys=[("i", "ascending"), ("k", "ascending")]))
                rank[order] = np.arange(chunk.rows)
                starts, ends = chunk.words()
                count = chunk.counts(starts)
                base = np.cumsum(count) - count
                hashes, size = A.shingles(chunk.hashes(starts, ends), count, s.least)
                # a text shorter than a run has a single one of all its words
                first = np.cumsum(size) - size
                size = np.where(count >= s.least, size, 0)
                spans = [batch.column(i).slice(chunk.lo, chunk.rows) for i in (3, 4)]
                of = np.repeat(np.arange(chunk.rows), np.diff(spans[0].offsets.to_numpy()))
                lo, hi = (x.flatten().to_numpy() for x in spans)
                hi = np.minimum(hi - s.least + 1, size[of])
                n = np.maximum(hi - lo, 0)
                row = np.repeat(of, n)
                word = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
                h = hashes[first[row] + word]
                # stretches may overlap at their margins
                order = np.lexsort((word, rank[row], h))
                row, word, h = row[order], word[order], h[order].view(np.int64)
                if not len(h):
                    continue
                key = keys[chunk.lo : chunk.hi][row]
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                yield _places(_SEED, h[at], own, row[at], key[at], word[at], row[at], key[at], word[at])
                at, other = _before(h, key, word)
                if len(at):
                    yield _places(_MATCH, A.mix(key[at].view(np.uint64)).view(np.int64), own, row[at], key[at], word[at], row[other], key[other], word[other])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text", "lo", "hi").mapInArrow(
        run, f"kind int, deal long, doc_id {kind}, key long, word long, other_doc_id {kind}, other long, other_word long"
    )


def _places(kind: int, deal, ids: pa.Array, row, key, word, other_row, other, other_word) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(deal), ids.take(pa.array(row)), pa.array(key), pa.array(word)]
    return pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(other_row)), pa.array(other), pa.array(other_word)], _PLACE)


def _meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places with an earlier one, from rows sorted by run and document; the first and the last row of a run in progress are carried along."""
    held = None
    for batch in batches:
        match = batch.column(0).to_numpy() == _MATCH
        if match.any():
            yield batch.filter(pa.array(match)).select(_PLACE[2:])
        new = batch.filter(pa.array(~match)).select(_PLACE[1:5])
        if not new.num_rows:
            continue
        old = 0 if held is None else held.num_rows
        rows = pa.Table.from_batches([new] if held is None else [*held.to_batches(), new]).combine_chunks()
        run, key, word = (rows.column(i).to_numpy() for i in (0, 2, 3))
        at, other = _before(run, key, word)
        at, other = at[at >= old], other[at >= old]
        if len(at):
            a, b = (rows.take(pa.array(i)).select([1, 2, 3]) for i in (at, other))
            yield from pa.Table.from_arrays([*a.columns, *b.columns], names=_PLACE[2:]).combine_chunks().to_batches()
        first = int(np.searchsorted(run, run[-1]))
        held = rows.take(pa.array(np.unique([first, len(run) - 1])))


def _verbatim(texts: DataFrame, repeated: DataFrame, stage: Stage, s: Settings) -> DataFrame:
    """The verbatim passages of ``texts`` (doc_id, key, text), with the columns of ``passages``. ``repeated``: key, word of the seeds that
    occur elsewhere too."""
    sorted_seeds = repeated.distinct().repartition("key").sortWithinPartitions("key", "word")
    suspects, seen = stage.put(sorted_seeds.mapInArrow(_suspects(s), "key long, lo array<long>, hi array<long>"))
    few = F.broadcast(suspects.select("key")) if seen["rows"] <= SENT_KEYS else suspects.select("key")
    runs = _run_rows(texts.join(few, "key", "left_semi").join(suspects, "key"), s)
    kind = texts.schema["doc_id"].dataType.simpleString()
    met = runs.repartition(F.col("deal")).sortWithinPartitions("deal", "kind", "doc_id", "key", "word").mapInArrow(
        _meet_runs, f"doc_id {kind}, key long, word long, other_doc_id {kind}, other long, other_word long"
    )
    # runs that go on in both documents are one passage
    way = F.col("word") - F.col("other_word")
    at = Window.partitionBy("doc_id", "key", "other_doc_id", "other", "way").orderBy("word")
    lines = met.distinct().withColumn("way", way).withColumn("line", F.col("word") - F.row_number().over(at))
    joined = lines.groupBy("doc_id", "key", "other_doc_id", "other", "way", "line").agg(F.min("word").alias("a"), (F.max("word") + s.least).alias("b"))
    return joined.select(
        "doc_id", "key", F.col("a").alias("start_word"), F.col("b").alias("end_word"), "other_doc_id",
        (F.col("a") - F.col("way")).alias("other_start_word"), (F.col("b") - F.col("way")).alias("other_end_word"), F.lit(1.0).alias("similarity"),
    )


def _stretches(rows: DataFrame) -> DataFrame:
    """pair, doc_id, lo and the word hashes of each asked stretch (lo, hi) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = (batch.column(i).to_numpy() for i in (2, 3))
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                starts, ends = chunk.words()
                h = (chunk.hashes(starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                count = chunk.counts(starts)
                base = np.cumsum(count) - count
                a = base + np.minimum(lo[chunk.lo : chunk.hi], count)
                b = base + np.minimum(hi[chunk.lo : chunk.hi], count)
                lists = [pa.array(h[i:j]) for i, j in zip(a.tolist(), b.tolist())]
                offsets = np.append(0, np.cumsum(b - a)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(lists))
                part = batch.slice(chunk.lo, chunk.rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), words], ["pair", "doc_id", "lo", "words"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("pair", "doc_id", "lo", "hi", "text").mapInArrow(run, f"pair long, doc_id {kind}, lo long, words array<int>")


def _align_all(s: Settings):
    names = ["pair", "start_word", "end_word", "other_start_word", "other_end_word", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            numbers = {n: columns[n].to_numpy().tolist() for n in ("pair", "lo", "other_lo")}
            lists = {n: (columns[n].offsets.to_numpy().tolist(), columns[n].values.to_numpy()) for n in ("words", "other_words", "xs", "ys")}
            for r in range(batch.num_rows):
                lo, other_lo = numbers["lo"][r], numbers["other_lo"][r]
                a, b, xs, ys = (values[at[r] : at[r + 1]] for at, values in lists.values())
                a, b, xs, ys = a.tolist(), b.tolist(), (xs - lo).tolist(), (ys - other_lo).tolist()
                for i, j, k, m, part in similar_parts(a, xs, b, ys, s):
                    found.append((numbers["pair"][r], i + lo, j + lo, k + other_lo, m + other_lo, part))
            values = list(zip(*found)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

    return run


#: Words on either side of a link that are compared before the texts are.
AROUND = 32
#: Links of a group that meet in one piece, and pairs of links that are compared at once.
BLOCK, PAIRS = 1024, 1 << 16
#: What stands past the ends of the words of the later and of the earlier side; steps over unlike words, as ``extend`` tries them.
_NOTHING = np.int32(-0x5BD1E995 >> 1), np.int32(0x1B873593)
_STEPS = ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1))


def _inside_periods(row: np.ndarray, word: np.ndarray, seed: np.ndarray, h: np.ndarray, base: np.ndarray, s: Settings) -> np.ndarray:
    """Which seeds stand inside a periodic stretch: not in its first period, nor in its last one."""
    order = np.lexsort((word, seed, row))
    r, w, k = row[order], word[order], seed[order]
    shift = np.diff(w, prepend=0)
    again = np.append(False, (r[1:] == r[:-1]) & (k[1:] == k[:-1])) & (shift <= s.gap + s.words)
    at = np.flatnonzero(again[:-1] & again[1:] & (shift[:-1] == shift[1:])) if len(row) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(row), dtype=bool)
    ahead = np.arange(s.gap + 2 * s.words)
    for lo in range(0, len(at), 1 << 14):
        part = at[lo : lo + (1 << 14)]
        p = shift[part][:, None]
        places = (base[r[part]] + w[part])[:, None] + np.minimum(ahead, p + s.words - 1)
        out[order[part[(h[places] == h[places - p]).all(1)]]] = True
    return out


def _lists_of(column: pa.Array, lo: int, n: int) -> tuple[np.ndarray, pa.Array]:
    """Row number and value of the entries of the lists of ``n`` rows from ``lo``."""
    part = column.slice(lo, n)
    return np.repeat(np.arange(n), np.diff(part.offsets.to_numpy())), part.flatten()


def _marks(rows: DataFrame, s: Settings) -> DataFrame:
    """doc_id, key, word, seed, held of the seeds of texts (doc_id, key, text, marks: their seeds that occur elsewhere, spans: their passages so far), without those inside
    periodic stretches. ``held``: the end of the passage that holds the word and goes furthest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                starts, ends = chunk.words()
                count = chunk.counts(starts)
                base = np.cumsum(count) - count
                h = chunk.hashes(starts, ends)
                shingle, own = A.shingles(h, count, s.words)
                row, word = _lists_of(batch.column(3), chunk.lo, chunk.rows)
                word = word.to_numpy().astype(np.int64)
                seed = shingle[(np.cumsum(own) - own)[row] + word]
                kept = ~_inside_periods(row, word, seed, h, base, s)
                row, word, seed = row[kept], word[kept], seed[kept]
                span_row, span = _lists_of(batch.column(4), chunk.lo, chunk.rows)
                lo, hi = ((span_row << 32) + span.field(name).to_numpy() for name in ("a", "b"))
                order = np.argsort(lo, kind="stable")
                lo, hi = np.append(-1, lo[order]), np.maximum.accumulate(np.append(-1, hi[order]))
                held = np.maximum(hi[np.searchsorted(lo, (row << 32) + word, side="right") - 1] - (row << 32), 0)
                columns = [keys[chunk.lo : chunk.hi][row], word.astype(np.int32), seed.view(np.int64), held.astype(np.int32)]
                ids = batch.column(0).take(pa.array(row + chunk.lo))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], ["doc_id", "key", "word", "seed", "held"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text", "marks", "spans").mapInArrow(run, f"doc_id {kind}, key long, word int, seed long, held int")


def _links(s: Settings):
    """doc_id, link, key, word, next_word, open of the links of texts from (doc_id, key, word, seed, held, many) of their seeds, sorted. Of two seeds one at
    least has ``many`` places: those of two places have been matched."""

    def of_keys(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, word, seed, held, many = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
        for step in range(1, len(key)):
            near = (key[step:] == key[:-step]) & (word[step:] - word[:-step] <= s.gap + s.words)
            if not near.any():
                break
            at = np.flatnonzero(near & (many[step:] | many[:-step]) & (word[step:] > word[:-step]))
            if len(at):
                link = A.mix(seed[at].view(np.uint64) ^ A.mix(seed[at + step].view(np.uint64) + np.uint64(1))).view(np.int64)
                columns = [link, key[at], word[at], word[at + step], held[at] < word[at + step] + s.words]
                ids = rows.column(0).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], ["doc_id", "link", "key", "word", "next_word", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()[0]
            key = rows.column(1).to_numpy()
            # the text in progress stays behind
            cut = int(np.searchsorted(key, key[-1]))
            yield from of_keys(rows.slice(0, cut))
            kept = [rows.slice(cut)]
        for rows in kept:
            yield from of_keys(rows)

    return run


def _surroundings(rows: DataFrame, s: Settings) -> DataFrame:
    """The links of texts (doc_id, key, text, links) one by one, with the number of their places (``n``; ``o``: of those that are open), the words after them
    (``left``, ``AROUND`` at most), and the hashes of ``AROUND`` words before (backwards) and after them."""
    names = ["link", "word", "next_word", "open", "n", "o"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(A.text_column(batch, lower=True)):
                starts, ends = chunk.words()
                count = chunk.counts(starts)
                base = np.cumsum(count) - count
                h = (chunk.hashes(starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row, links = _lists_of(batch.column(3), chunk.lo, chunk.rows)
                word, after = (links.field(i).to_numpy().astype(np.int64) for i in (1, 2))
                after = after + s.words
                around = np.arange(AROUND)
                for lo in range(0, len(row), 1 << 13):
                    part = slice(lo, lo + (1 << 13))
                    first, end = base[row[part]], (base + count)[row[part]]
                    places = np.hstack([(first + word[part])[:, None] - 1 - around, (first + after[part])[:, None] + around])
                    words = h[np.clip(places, 0, len(h) - 1)]
                    offsets = np.arange(len(words) + 1, dtype=np.int32) * np.int32(8 * AROUND)
                    packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words))])
                    where = pa.array(row[part] + chunk.lo)
                    left = pa.array(np.minimum(end - first - after[part], AROUND).astype(np.int32))
                    own = links.slice(lo, 1 << 13)
                    columns = [batch.column(0).take(where), batch.column(1).take(where), *(own.field(i) for i in range(6)), left, packed]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", *names, "left", "around"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "key", "text", "links").mapInArrow(
        run, f"doc_id {kind}, key long, link long, word int, next_word int, open boolean, n long, o long, left int, around binary"
    )


def _reach(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """For pairs of rows (``a`` of ``p``, ``b`` of ``q``, of ``n`` and ``m`` words) how far ``extend`` goes in the first by its generous cost; ``least`` where
    ``AROUND`` words do not tell. The rows are filled up with words that are equal to nothing."""
    cost, width = s.similarity / (1 - s.similarity) / 2, p.shape[1]
    # the words up to the first that differs; past the last place but three words would be asked for that are not given
    out = np.argmin(np.hstack([p[a, :AROUND] == q[b, :AROUND], np.zeros((len(a), 1), dtype=bool)]), axis=1)
    least = np.minimum(n[a], m[b])
    told = (out >= least) & (least <= AROUND - 3)
    lane = np.flatnonzero(~told & (out <= AROUND - 4))
    out[~told & (out > AROUND - 4)] = s.least
    p, q = p.ravel(), q.ravel()
    # steps over unlike words that end a walk; where no word is equal and no two words are within two places of it, nothing else can follow
    end = int(np.ceil(s.drop / cost))
    words = [np.lib.stride_tricks.sliding_window_view(v, end + 1) for v in (p, q)]
    twos = [np.append(v[:-1] * v.dtype.type(31) + v[1:], v[-1:]) for v in (p, q)]
    twos = [np.lib.stride_tricks.sliding_window_view(v, end + 2) for v in twos]
    n, m = n[a[lane]], m[b[lane]]
    at_p, at_q = a[lane] * width, b[lane] * width
    end_p, end_q = at_p + n, at_q + m
    # further on words may be asked for that lie beyond those given
    far_p = np.where(n == AROUND, at_p + AROUND - 4, end_p)
    far_q = np.where(m == AROUND, at_q + AROUND - 4, end_q)
    start, best_x = at_p, out[lane]
    at_p, at_q, best = at_p + best_x, at_q + best_x, best_x.astype(np.float64)
    total = best.copy()
    fresh = np.ones(len(lane), dtype=bool)
    while len(lane):
        same = p[at_p] == q[at_q]
        seen = np.flatnonzero(fresh & ~same & (at_p + end + 3 <= far_p + 4) & (at_q + end + 3 <= far_q + 4))
        i, k = at_p[seen], at_q[seen]
        done = ~(words[0][i] == words[1][k]).any(1)
        i, k, seen = i[done], k[done], seen[done]
        one, two = twos[0][i], twos[1][k]
        done = ~(one == two).any(1)
        for off in (1, 2):
            done &= ~(one[:, off:] == two[:, :-off]).any(1) & ~(one[:, :-off] == two[:, off:]).any(1)
        seen = seen[done]
        if len(seen):
            out[lane[seen]] = best_x[seen]
            go = np.ones(len(lane), dtype=bool)
            go[seen] = False
            lane, at_p, at_q, end_p, end_q, far_p, far_q, same = (v[go] for v in (lane, at_p, at_q, end_p, end_q, far_p, far_q, same))
            start, total, best, best_x = (v[go] for v in (start, total, best, best_x))
        fresh = same
        dx = np.ones(len(lane), dtype=np.int64)
        dy = np.ones(len(lane), dtype=np.int64)
        open_ = np.flatnonzero(~same)
        for x, y in _STEPS:
            i, k = at_p[open_] + x, at_q[open_] + y
            hit = p[i] == q[k]
            hit[hit] = p[i[hit] + 1] == q[k[hit] + 1]
            dx[open_[hit]], dy[open_[hit]] = x, y
            open_ = open_[~hit]
        total += np.where(same, 1.0, -cost * np.maximum(dx, dy))
        at_p, at_q = at_p + dx, at_q + dy
        better = same & (total > best)
        best[better], best_x[better] = total[better], (at_p - start)[better]
        ended = (total <= best - s.drop) | (at_p >= end_p) | (at_q >= end_q)
        unknown = ~ended & ((at_p > far_p) | (at_q > far_q))
        out[lane[ended]], out[lane[unknown]] = best_x[ended], s.least
        go = ~(ended | unknown)
        lane, at_p, at_q, end_p, end_q, far_p, far_q = (v[go] for v in (lane, at_p, at_q, end_p, end_q, far_p, far_q))
        start, total, best, best_x, fresh = (v[go] for v in (start, total, best, best_x, fresh))
    return out


def _meet_links(s: Settings):
    """Matches (key, word, other, other_word) from links sorted by cell and document: of each two of a cell, the later one open, that may be in a passage."""

    def of_cells(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        number = {c: rows.column(c).to_numpy() for c in ("cell", "key", "word", "next_word", "left", "later", "partner")}
        cell, key, word = number["cell"], number["key"], number["word"].astype(np.int64)
        after = number["next_word"].astype(np.int64)
        size = len(cell)
        head = np.append(True, cell[1:] != cell[:-1])
        first = np.maximum.accumulate(np.where(head, np.arange(size), 0))
        place = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (word[1:] != word[:-1]) | (after[1:] != after[:-1])) | head)
        partners = np.append(0, np.cumsum(number["partner"]))
        partner = np.flatnonzero(number["partner"])
        later = np.flatnonzero(number["later"])
        before = partners[later] - partners[first[later]]
        later, before = later[before > 0], before[before > 0]
        if not len(later):
            return
        lengths = np.minimum(word, AROUND), number["left"].astype(np.int64)
        data, _ = A.raw(rows.column("around").combine_chunks().cast(pa.large_binary()))
        words = data.view(np.int32).reshape(size, 2, AROUND)
        sides = []
        for side, length in enumerate(lengths):
            wide = np.zeros((size, AROUND + 4), dtype=np.int32)
            wide[:, :AROUND] = words[:, side]
            past = np.arange(AROUND + 4) >= length[:, None]
            sides.append(tuple(np.where(past, nothing, wide) for nothing in _NOTHING))
        ends = np.cumsum(before)
        lo = 0
        while lo < len(later):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            n = before[lo:hi]
            a = np.repeat(later[lo:hi], n)
            b = partner[np.arange(len(a)) - np.repeat(np.cumsum(n) - n - partners[first[later[lo:hi]]], n)]
            lo = hi
            other = place[a] != place[b]
            a, b = a[other], b[other]
            reach = after[a] + s.words - word[a]
            for (p, q), length in zip(sides, lengths):
                short = np.flatnonzero(reach < s.least)
                reach[short] += _reach(p, length, q, length, a[short], b[short], s)
            a, b = a[reach >= s.least], b[reach >= s.least]
            if len(a):
                ends_of = [np.concatenate([v[i] for v in (word, after)]).astype(np.int32) for i in (a, b)]
                columns = [np.tile(key[a], 2), ends_of[0], np.tile(key[b], 2), ends_of[1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "word", "other", "other_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            # the cell in progress stays behind
            if held and (cut or held[-1].column(0)[-1].as_py() != cell[0]):
                yield from of_cells(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            elif cut:
                yield from of_cells(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from of_cells(pa.Table.from_batches(held).combine_chunks())

    return run


def _open_matches(texts: DataFrame, repeated: DataFrame, found: DataFrame, stage: Stage, s: Settings) -> DataFrame:
    """key, word, other, other_word of matches at links of ``texts`` that no passage of ``found`` (key, a, b) holds, with the same links of all earlier places.

    Links with more than ``BLOCK`` places are dealt into a grid, open places by all places, so that no task holds all of them.
    """
    marks = repeated.distinct().groupBy("key").agg(F.sort_array(F.collect_list("word")).alias("marks"))
    spans = found.distinct().groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    nothing = F.array().cast("array<struct<a:bigint,b:bigint>>")
    marked = texts.join(marks.filter(F.size("marks") > 1), "key").join(spans, "key", "left").withColumn("spans", F.coalesce("spans", nothing))
    seeds_ = stage.table(_marks(marked, s))
    many = stage.table(seeds_.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("seed", F.lit(True).alias("many")))
    told = seeds_.join(many, "seed", "left").select("doc_id", "key", "word", "seed", "held", F.coalesce("many", F.lit(False)).alias("many"))
    by_text = told.repartition("key").sortWithinPartitions("key", "word")
    kind = texts.schema["doc_id"].dataType.simpleString()
    links = stage.table(by_text.mapInArrow(_links(s), f"doc_id {kind}, link long, key long, word int, next_word int, open boolean"))
    # only what has an open place behind it in its group is of use
    groups = links.groupBy("link").agg(F.min("doc_id").alias("first"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last"))
    useful = stage.table(links.join(groups.filter("first <= last").select("link", "last"), "link").filter("doc_id <= last").drop("last"))
    busy = stage.table(useful.groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("o")).filter("n > 1"))
    of_text = useful.join(busy, "link").groupBy("key").agg(F.collect_set(F.struct("link", "word", "next_word", "open", "n", "o")).alias("links"))
    rows = _surroundings(texts.join(of_text, "key"), s)
    across, down = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "o"))
    own = F.xxhash64("key", "word", "next_word")

    def cell(x, y, later, partner):
        return F.struct(F.xxhash64("link", x, y).alias("cell"), later.alias("later"), partner.alias("partner"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    as_partner = F.transform(F.sequence(zero, down - 1), lambda y: cell(F.pmod(own, across).cast("int"), y, no, yes))
    as_later = F.transform(F.sequence(zero, across - 1), lambda x: cell(x, F.pmod(own, down).cast("int"), yes, no))
    whole = F.array(cell(zero, zero, F.col("open"), yes))
    cells = F.when(F.col("n") <= BLOCK, whole).when(F.col("open"), F.concat(as_partner, as_later)).otherwise(as_partner)
    dealt = rows.select(F.inline(cells), "doc_id", "key", "word", "next_word", "left", "around")
    sorted_cells = dealt.repartition(F.col("cell")).sortWithinPartitions("cell", "doc_id", "key", "word", "next_word")
    return sorted_cells.select("cell", "key", "word", "next_word", "left", "later", "partner", "around").mapInArrow(
        _meet_links(s), "key long, word int, other long, other_word int"
    )


def _chains(matches: DataFrame, s: Settings) -> DataFrame:
    grouped = matches.repartition("key", "other").sortWithinPartitions("key", "other")
    return grouped.mapInArrow(_chain_up(s), "key long, x0 long, x1 long, other long, y0 long, y1 long, xs array<int>, ys array<int>")


def _aligned(keyed: DataFrame, chains_: DataFrame, stage: Stage, s: Settings) -> DataFrame:
    """The passages of chains (rows of ``_chain_up``) of the texts ``keyed`` (doc_id, key, text)."""
    found, count = stage.put(chains_.withColumn("pair", F.monotonically_increasing_id()))

    def side(name: str, lo: str, hi: str) -> DataFrame:
        from_word, to_word = F.greatest(F.col(lo) - s.margin, F.lit(0)), F.col(hi) + s.margin
        return found.select("pair", F.col(name).alias("key"), from_word.alias("lo"), to_word.alias("hi"))

    sides = side("key", "x0", "x1").withColumn("later", F.lit(True)).unionByName(side("other", "y0", "y1").withColumn("later", F.lit(False)))
    wanted = stage.table(sides.select("key").distinct())
    only = F.broadcast(wanted) if count["rows"] <= SENT_KEYS else wanted
    own = keyed.join(only, "key", "left_semi")
    cut = stage.table(
        _stretches(own.join(sides.filter("later"), "key")).withColumn("later", F.lit(True))
        .unionByName(_stretches(own.join(sides.filter("not later"), "key")).withColumn("later", F.lit(False)))
    )
    later = cut.filter("later").select("pair", "doc_id", "lo", "words")
    other = cut.filter("not later").select(
        "pair", F.col("doc_id").alias("other_doc_id"), F.col("lo").alias("other_lo"), F.col("words").alias("other_words")
    )
    chain = found.select("pair", "key", "xs", "ys")
    both = later.join(other, "pair").join(chain, "pair")
    good = both.select("pair", "lo", "words", "other_lo", "other_words", "xs", "ys").mapInArrow(
        _align_all(s),
        "pair long, start_word long, end_word long, other_start_word long, other_end_word long, similarity double",
    )
    names = later.select("pair", "doc_id").join(other.select("pair", "other_doc_id"), "pair").join(chain.select("pair", "key"), "pair")
    return stage.table(good.join(names, "pair").select(*_COLUMNS))


_COLUMNS = ["doc_id", "key", "start_word", "end_word", "other_doc_id", "other_start_word", "other_end_word", "similarity"]


def passages(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, key, start_word, end_word, other_doc_id, other_start_word, other_end_word, similarity of the passages of ``docs`` (doc_id,
    text) that an earlier document, or an earlier place of the same one, has too. ``key``: ``row_key`` of the document."""
    stage = Stage(docs.sparkSession, "passage-chains")
    text_key = F.xxhash64("text")
    named = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    least = stage.table(named.select("doc_id", text_key.alias("text_key")).groupBy("text_key").agg(F.min("doc_id").alias("kept_id")))
    ids = named.select("doc_id", text_key.alias("text_key")).join(least, "text_key").filter("doc_id <> kept_id").distinct()
    copies, seen = stage.put(ids.select(F.col("text_key").alias("copy_key"), F.col("doc_id").alias("copy_id"), "kept_id"))
    sent = F.broadcast(copies) if seen["rows"] <= SENT_KEYS else copies
    is_copy = (text_key == F.col("copy_key")) & (F.col("doc_id") == F.col("copy_id"))
    keyed = named.withColumn("key", row_key())
    texts = keyed.join(sent.select("copy_key", "copy_id"), is_copy, "left_anti")

    dealt = _seed_rows(texts, s).repartition(F.col("deal")).sortWithinPartitions("deal", "kind", "doc_id", "key", "word")
    matches = dealt.mapInArrow(_meet, "key long, word int, other long, other_word int")
    is_chain = F.col("x0").isNotNull()
    both = stage.table(_chains(matches, s))
    met = both.filter(~is_chain)
    repeated = met.select("key", F.explode("xs").alias("word")).unionByName(met.select(F.col("other").alias("key"), F.explode("ys").alias("word")))
    verbatim = stage.table(_verbatim(texts, repeated, stage, s))
    runs = verbatim.select(F.col("key").alias("run_key"), F.col("start_word").alias("run_start"), F.col("end_word").alias("run_end")).distinct()
    in_run = (F.col("key") == F.col("run_key")) & (F.col("run_start") <= F.col("x0")) & (F.col("run_end") >= F.col("x1"))
    distinct_chains = both.filter(is_chain).distinct().join(runs, in_run, "left_anti")
    fuzzy = _aligned(keyed, distinct_chains, stage, s)
    spans = fuzzy.unionByName(verbatim).select("key", F.col("start_word").alias("a"), F.col("end_word").alias("b"))
    rest = _chains(_open_matches(texts, repeated, spans, stage, s).distinct(), s).filter(is_chain)
    fuzzy = fuzzy.unionByName(_aligned(keyed, rest.distinct(), stage, s))
    known = fuzzy.select(F.col("key").alias("known_key"), F.col("start_word").alias("known_start"), F.col("end_word").alias("known_end"))
    inside = (F.col("key") == F.col("known_key")) & (F.col("known_start") <= F.col("start_word")) & (F.col("known_end") >= F.col("end_word"))
    verbatim = verbatim.join(known, inside, "left_anti").select(*_COLUMNS)
    # copies: the whole text
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    # written first: the filter on the number of words would else be pushed below the join, to the texts of all documents
    whole = stage.table(keyed.join(sent, is_copy).select("doc_id", "key", n_words.alias("end_word"), F.col("kept_id").alias("other_doc_id")))
    exact = whole.filter(F.col("end_word") >= s.least).select(
        "doc_id", "key", F.lit(0).cast("long").alias("start_word"), "end_word", "other_doc_id",
        F.lit(0).cast("long").alias("other_start_word"), F.col("end_word").alias("other_end_word"), F.lit(1.0).alias("similarity"),
    )
    return fuzzy.unionByName(verbatim).unionByName(exact).distinct()


def remove_passages(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs``, all columns and rows, without the passages that an earlier document has; ``n_chars``, if there, is set anew."""
    columns = docs.columns
    key, spans = A.unused(columns, "passage_key"), A.unused(columns, "passage_spans")
    span = F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))
    found = passages(docs, s).groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_set(span)).alias(spans))
    marked = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), row_key())).join(found, key, "left")
    # texts without a passage do not leave the JVM
    clean = marked.filter(F.col(spans).isNull()).select(*columns)
    cut = marked.filter(F.col(spans).isNotNull()).select(*columns, spans)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = A.text_column(batch), []
            for chunk in A.chunks(texts):
                starts, ends = chunk.words()
                first = np.append(0, np.cumsum(chunk.counts(starts)))
                data = chunk.data.tobytes()
                for r in range(chunk.rows):
                    lo, parts = int(chunk.offsets[r]), []
                    for part in batch.column(len(columns))[chunk.lo + r].as_py():
                        a, b = int(starts[first[r] + part["a"]]), int(ends[first[r] + part["b"] - 1])
                        if a > lo:
                            parts.append(data[lo:a])
                        lo = max(lo, b)
                    parts.append(data[lo : int(chunk.offsets[r + 1])])
                    out.append(b"".join(parts).decode("utf-8", "replace"))
            kept = batch.columns[: len(columns)]
            kept[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(kept, columns)

    out = clean.unionByName(cut.mapInArrow(run, docs.schema))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
