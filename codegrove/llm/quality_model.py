"""Quality classifier: supervised subword embeddings.

Every word, pair of neighbouring words and byte n-gram of a document is hashed to a learned vector; the mean of the vectors goes
through a softmax layer. Both are trained together by stochastic gradient descent in numpy on a bounded sample. A word equal to
the word before it counts as a word of its own ("repeated"), so that the mean sees repetition of any word.

Scoring needs no vectors: as the layer is linear, the mean of the vectors times the layer is the mean of one number per
feature, which is folded into a table when training ends. Whole texts are scored, in chunks of bounded size.

Defined results: a null or empty text, or one without features, scores the learned bias. Repeated rows score alike. A text column
with other names beside it is ignored. Without labels of both kinds the score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.llm import arrays as A
from codegrove.llm import sampling


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the training sample: at most so many documents of each label."""

    per_class: int = 1000
    bits: int = 17
    dim: int = 12
    epochs: int = 5
    rate: float = 20.0
    grams: tuple[int, ...] = (3, 4)


@dataclass(frozen=True)
class Model:
    settings: Settings
    table: np.ndarray  # one number per bucket: its vector through the output layer, label 1 less label 0
    bias: float


def _features(chunk: A.Chunk, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, ascending byte positions) of each family of features."""
    shift = np.uint64(64 - s.bits)
    starts, ends = chunk.words()
    h = chunk.hashes(starts, ends)
    yield h >> shift, starts
    if len(h) > 1:
        row = chunk.row_of(starts)
        near = row[1:] == row[:-1]
        yield A.mix(h[:-1][near] * np.uint64(3) + h[1:][near]) >> shift, starts[1:][near]
        same = near & (h[1:] == h[:-1])
        yield np.full(int(same.sum()), 1, dtype=np.uint64), starts[1:][same]
    for n in s.grams:
        g, at = chunk.ngrams(n, n)
        yield g >> shift, at


def _bags(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    bags = []
    for chunk in A.chunks(pa.array(texts, pa.large_string())):
        families = list(_features(chunk, s))
        for r in range(chunk.rows):
            lo, hi = chunk.offsets[r], chunk.offsets[r + 1]
            own = [b[np.searchsorted(at, lo) : np.searchsorted(at, hi)] for b, at in families]
            ids, n = np.unique(np.concatenate(own), return_counts=True)
            bags.append((ids.astype(np.int64), n / max(1, n.sum())))
    return bags


def fit(rows: list[tuple], share: float, s: Settings = Settings()) -> Model:
    """Train on (doc_id, text, label 0 or 1) rows; ``share`` is the share of label 1 among all labelled documents."""
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    y = np.array([int(r[2]) for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(s, np.zeros(1 << s.bits, dtype=np.float32), prior)
    bags = _bags([r[1] for r in rows], s)
    rng = np.random.default_rng(7)
    vectors = ((rng.random((1 << s.bits, s.dim)) - 0.5) / s.dim).astype(np.float32)
    layer = (rng.random((s.dim, 2)) - 0.5).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))  # both labels count alike; the prior comes back below
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(len(bags)):
            ids, part = bags[i]
            part = part.astype(np.float32)
            h = part @ vectors[ids]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = layer @ p
            layer -= 0.02 * rate * np.outer(h, p)
            bias -= 0.002 * rate * p
            vectors[ids] -= rate * np.outer(part, back)
    table = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(s, table.astype(np.float32), float(bias[1] - bias[0]) + prior)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.empty(len(texts))
    for chunk in A.chunks(texts):
        total, n = np.zeros(chunk.rows), np.zeros(chunk.rows)
        for buckets, at in _features(chunk, model.settings):
            total += chunk.sums(at, model.table[buckets.astype(np.int64)])
            n += chunk.counts(at)
        z = total / np.maximum(n, 1) + model.bias
        out[chunk.lo : chunk.hi] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> Model:
    """Fit on a bounded sample of ``docs`` (doc_id, text) with 0/1 ``labels`` (doc_id, ``label``)."""
    counts = labels.filter(F.col(label).isin(0, 1)).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).first()
    share = counts.ones / counts.n if counts.n else 0.5
    return fit(sampling.labelled_sample(docs, labels, label, [0, 1], s.per_class), share, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(A.text_column(batch), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
