"""Toxicity by a linear-chain conditional random field over words.

Labels come by document, the field needs labelled words. A word of a toxic training document is labelled toxic if it, or one of its
first three to eight letters, is a marker: its distinct contexts (the words before and after) lie in toxic documents far more often
than in others. Contexts, not
occurrences, are counted, and near copies of a toxic document already counted are left out, so that they mark none of its plain words.

Weights of hashed features (the word, its neighbours, its first and last letters) and transitions are trained in numpy by gradient
ascent on the likelihood of the labelled words. Forward-backward marginals over whole texts give toxic spans with offsets and
scores; the expected number of toxic words, its share of all words and the highest marginal are calibrated to a document score by logistic regression.

The two-state recursions run over all texts of a chunk at once: words are cut into blocks, each block's product of transfer
matrices is formed side by side, carried over the blocks of a text, and each block is then run from its exact entry state.

Defined results: null or empty texts, or texts without a word, have no span and the calibrated score of no toxic word. Repeated rows score
alike; other columns are ignored. Without labels of both kinds the score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.llm import sampling

BLOCK = 128
_EDGE = np.uint64(0x5151515151515151)


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the training sample: at most so many documents of each label."""

    per_class: int = 500
    bits: int = 17
    rounds: int = 20
    rate: float = 0.5
    marker_contexts: float = 0.05  # distinct contexts of a marker, as a share of the toxic documents of the sample
    marker_ratio: float = 20.0
    span: float = 0.5  # marginal from which a word belongs to a span


@dataclass(frozen=True)
class Model:
    settings: Settings
    weights: np.ndarray  # by bucket: score of state 1 less that of state 0
    moves: np.ndarray  # 2 x 2 log potentials, from state to state
    start: np.ndarray  # log potentials of the first state
    link: np.ndarray  # calibration: weights of what ``_evidence`` gives


def _features(chunk: A.Chunk, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each feature by word, and the words' ranges and number by row."""
    starts, ends = chunk.words()
    counts = chunk.counts(starts)
    # punctuation around a word is no part of it
    plain = chunk.data
    for _ in range(3):
        wide = ends - starts > 1
        starts = starts + (wide & _PUNCTUATION[plain[starts]])
        wide = ends - starts > 1
        ends = ends - (wide & _PUNCTUATION[plain[ends - 1]])
    word = chunk.hashes(starts, ends)
    n = len(word)
    before, after = np.full(n, _EDGE), np.full(n, _EDGE)
    if n > 1:
        row = np.repeat(np.arange(chunk.rows), counts)
        near = row[1:] == row[:-1]
        before[1:][near] = word[:-1][near]
        after[:-1][near] = word[1:][near]
    # ends of the first few letters: letters begin at bytes that continue no other
    letters = np.cumsum((chunk.data & 0xC0) != 0x80)
    opening = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    first = letters[starts] - 1 if n else np.zeros(0, dtype=np.int64)
    opening = np.append(opening, [len(chunk.data)] * 9)
    heads = [chunk.hashes(starts, np.minimum(opening[first + k], ends)) for k in _HEADS]
    tail = chunk.hashes(np.maximum(ends - 3, starts), ends)
    shift = np.uint64(64 - bits)
    kinds = [A.mix(h + np.uint64(k + 1)) >> shift for k, h in enumerate((word, before, after, tail, *heads))]
    return [k.astype(np.int64) for k in kinds], starts, ends, counts


_HEADS = (3, 4, 5, 7)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def marginals(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of state 1 for each word. ``scores``: of state 1 less state 0, texts one after the other.

    Exact up to rounding: blocks of a text are joined by products of their transfer matrices.
    """
    n = len(scores)
    if n == 0:
        return np.zeros(0)
    e = np.exp(np.clip(scores, -30, 30))
    m, s = np.exp(moves), np.exp(start)
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    owner = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(counts) - counts, blocks) + nth * BLOCK
    size = np.minimum(BLOCK, counts[owner] - nth * BLOCK)
    cells = begin[:, None] + np.minimum(np.arange(BLOCK), size[:, None] - 1)
    grid = np.where(np.arange(BLOCK) < size[:, None], e[cells], 1.0).T.copy()
    live = (np.arange(BLOCK)[:, None] < size[None, :])

    def sweep(order: range, matrix: np.ndarray, entry: np.ndarray, keep: bool):
        """Vectors (blocks x 2) through the blocks in ``order``; the state before each word when ``keep``."""
        v, seen = entry, np.empty((BLOCK, *entry.shape)) if keep else None
        for t in order:
            w = v @ matrix
            if keep:
                seen[t] = w
            w = w * np.stack([np.ones(total), grid[t]], 1)[(slice(None),) + (None,) * (entry.ndim - 2)]
            w /= w.sum(-1, keepdims=True)
            v = np.where(live[t].reshape(-1, *[1] * (entry.ndim - 1)), w, v)
        return v, seen

    def carried(order: range, matrix: np.ndarray, opening: np.ndarray, from_end: bool) -> np.ndarray:
        """State on entry to each block."""
        entry = np.tile(opening, (total, 1))
        deepest = int(blocks.max())
        if deepest > 1:
            # each block maps both unit states to their images; scale is kept by not normalising them apart
            images = np.tile(np.eye(2), (total, 1, 1))
            for t in order:
                w = (images @ matrix) * np.stack([np.ones(total), grid[t]], 1)[:, None, :]
                w /= w.sum((1, 2), keepdims=True)
                images = np.where(live[t][:, None, None], w, images)
            rank = (blocks[owner] - 1 - nth) if from_end else nth
            by_rank = np.argsort(rank, kind="stable")
            cuts = np.searchsorted(rank[by_rank], np.arange(deepest + 1))
            for k in range(1, deepest):
                here = by_rank[cuts[k] : cuts[k + 1]]
                source = here + 1 if from_end else here - 1
                v = np.einsum("bi,bij->bj", entry[source], images[source])
                entry[here] = v / v.sum(1, keepdims=True)
        return entry

    # the opening vector is chosen so that one move gives the start potentials
    opening = np.linalg.solve(m.T, s) if abs(np.linalg.det(m)) > 1e-12 else s
    forward_entry = carried(range(BLOCK), m, opening, False)
    _, before = sweep(range(BLOCK), m, forward_entry, True)
    back = range(BLOCK - 1, -1, -1)
    backward_entry = carried(back, m.T, np.linalg.solve(m, np.ones(2)) if abs(np.linalg.det(m)) > 1e-12 else np.ones(2), True)
    _, behind = sweep(back, m.T, backward_entry, True)
    joint = before * behind
    joint[..., 1] *= grid
    p = (joint[..., 1] / joint.sum(-1)).T
    return np.clip(p[live.T], 0.0, 1.0)


def _lower(texts: list[str]) -> pa.Array:
    return A.pc.utf8_lower(pa.array(texts, pa.large_string()))


def _markers(rows: list[tuple], s: Settings) -> set[str]:
    """Words, and first letters of words, whose distinct contexts lie in toxic documents."""
    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    contexts: tuple[set, set] = (set(), set())
    documents: Counter = Counter()
    sketches: list[set] = []
    for _, text, label in rows:
        words = [w.strip(strip) for w in text.lower().split()]
        # a near copy of an earlier toxic document tells nothing new: half of its smallest word hashes are known
        if int(label) == 1:
            sketch = set(sorted(zlib.crc32(w.encode()) for w in set(words))[:32])
            if any(2 * len(sketch & other) > len(sketch) for other in sketches):
                continue
            sketches.append(sketch)
        documents[int(label)] += 1
        contexts[int(label)].update(zip(["", *words], words, [*words[1:], ""]))
    toxic, clean = (Counter(u for c in contexts[k] for u in _units(c[1])) for k in (1, 0))
    least = max(3.0, s.marker_contexts * documents[1])
    scale = documents[0] / max(1, documents[1])
    return {w for w, n in toxic.items() if n >= least and n * scale > s.marker_ratio * (clean[w] + 0.5)}


def _units(word: str) -> set[str]:
    """The word, and its first letters followed by a star."""
    return {word, *(word[:k] + "*" for k in range(3, 9) if len(word) >= k)} - {""}


def fit(rows: list[tuple], share: float, s: Settings = Settings()) -> Model:
    """Train on (doc_id, text, label 0 or 1) rows; ``share`` is the share of label 1 among all labelled documents."""
    prior = math.log((share + 1e-6) / (1 - share + 1e-6))
    weights = np.zeros(1 << s.bits)
    start, moves = np.zeros(2), np.zeros((2, 2))
    labels = np.array([int(r[2]) for r in rows])
    if len(set(labels.tolist())) < 2:
        return Model(s, weights, moves, start, np.array([prior, 0.0, 0.0, 0.0]))
    markers = _markers(rows, s)
    texts = _lower([r[1] for r in rows])
    parts, gold, sizes = [], [], []
    for chunk in A.chunks(texts):
        kinds, starts, ends, counts = _features(chunk, s.bits)
        parts.append(np.stack(kinds, 1))
        known: dict[bytes, bool] = {}
        text = chunk.data.tobytes()
        toxic = np.repeat(labels[chunk.lo : chunk.hi] == 1, counts)
        hit = np.zeros(len(starts), dtype=bool)
        for i in np.flatnonzero(toxic).tolist():
            w = text[starts[i] : ends[i]]
            if w not in known:
                known[w] = not markers.isdisjoint(_units(w.decode("utf-8", "replace")))
            hit[i] = known[w]
        gold.append(hit)
        sizes.append(counts)
    x, y, counts = np.concatenate(parts), np.concatenate(gold).astype(float), np.concatenate(sizes)
    width = x.shape[1]
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(-1, width)
    w, squares = np.zeros(len(used)), np.full(len(used), 1e-6)
    n, positive = len(y), max(1.0, y.sum())
    offset, offset_squares = math.log((positive + 1) / (n + 1)), 1e-6
    # transitions are counted from the labelled words; features are trained against them
    row = np.repeat(np.arange(len(counts)), counts)
    near = row[1:] == row[:-1]
    pairs = np.ones((2, 2))
    np.add.at(pairs, (y[:-1][near].astype(int), y[1:][near].astype(int)), 1)
    rate_of = pairs.sum(0) / pairs.sum()
    moves = np.log(pairs / pairs.sum(1, keepdims=True)) - np.log(rate_of)
    for _ in range(s.rounds):
        p = marginals(w[x].sum(1) + offset, counts, moves, start)
        pull = y - p
        g = np.bincount(x.ravel(), weights=np.repeat(pull, width), minlength=len(used)) - 1e-3 * w
        squares += g * g
        w += s.rate * g / np.sqrt(squares)
        offset_squares += pull.sum() ** 2
        offset += 0.2 * s.rate * pull.sum() / math.sqrt(offset_squares)
    weights[used] = w
    model = Model(s, weights, moves + np.array([0.0, offset]), start + np.array([0.0, offset]), np.zeros(4))
    evidence, _ = _pass(texts, model, False)
    return Model(s, weights, model.moves, model.start, _calibrate(evidence, labels, share))


def _calibrate(x: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression by Newton steps, each label weighted to its share of all documents."""
    have = labels.mean()
    weight = np.where(labels == 1, share / have, (1 - share) / (1 - have))
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        b = b + np.linalg.solve(hessian, x.T @ (weight * (labels - p)) - 1e-2 * b)
    return b


def _word_marginals(chunk: A.Chunk, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds, starts, ends, counts = _features(chunk, m.settings.bits)
    scores = np.zeros(len(starts))
    for k in kinds:
        scores += m.weights[k]
    return marginals(scores, counts, m.moves, m.start), starts, ends, counts


def _pass(texts: pa.Array, m: Model, spans: bool) -> tuple[np.ndarray, list[list[dict]]]:
    """What the marginals say about each text (rows of calibration inputs) and, if asked for, its toxic spans."""
    evidence = np.zeros((len(texts), 4))
    evidence[:, 0] = 1
    found: list[list[dict]] = [[] for _ in range(len(texts) if spans else 0)]
    for original in A.chunks(texts):
        # lower case may change the length of a word in bytes, but not the number of words
        low = A.whole(A.pc.utf8_lower(texts.slice(original.lo, original.rows)))
        p, starts, _, counts = _word_marginals(low, m)
        expected = low.sums(starts, p)
        evidence[original.lo : original.hi, 1] = np.log1p(expected)
        evidence[original.lo : original.hi, 2] = np.sqrt(expected / np.maximum(counts, 1))
        full = np.flatnonzero(counts)
        if len(full):
            evidence[original.lo + full, 3] = np.maximum.reduceat(p, (np.cumsum(counts) - counts)[full])
        hot = np.flatnonzero(p >= m.settings.span) if spans else ()
        if len(hot):
            starts, ends = original.words()
            row = original.row_of(starts[hot])
            letter = np.concatenate([[0], np.cumsum((original.data & 0xC0) != 0x80)])
            for group in np.split(np.arange(len(hot)), np.flatnonzero((np.diff(hot) > 1) | (np.diff(row) > 0)) + 1):
                r, a, b = row[group[0]], starts[hot[group[0]]], ends[hot[group[-1]]]
                base = letter[original.offsets[r]]
                found[original.lo + r].append({"start": letter[a] - base, "end": letter[b] - base, "score": p[hot[group]].max()})
    return evidence, found


def tag_texts(texts: pa.Array, m: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """Probability of label 1, and the toxic spans: ``start``, ``end`` (code points) and ``score`` (the highest marginal within)."""
    evidence, spans = _pass(texts, m, True)
    return 1 / (1 + np.exp(-np.clip(evidence @ m.link, -40, 40))), spans


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", s: Settings = Settings()) -> Model:
    """Fit on a bounded sample of ``docs`` (doc_id, text) with 0/1 ``labels`` (doc_id, ``label``)."""
    counts = labels.filter(F.col(label).isin(0, 1)).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).first()
    share = counts.ones / counts.n if counts.n else 0.5
    return fit(sampling.labelled_sample(docs, labels, label, [0, 1], s.per_class), share, s)


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``spans`` (start, end, score; code points) of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = tag_texts(A.text_column(batch), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    narrow = docs.select("doc_id", "text")
    row = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {row}, score double, spans array<struct<start:bigint,end:bigint,score:double>>")
