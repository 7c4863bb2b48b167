"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier per bit, logistic over hashed byte n-grams and trained by stochastic gradient
descent in numpy, predicts that bit of the language's codeword. A text goes to the codeword of least loss, each bit weighted by
how reliably it was predicted for that language in training; a text whose two best codewords are nearly as good is flagged.

Up to six languages get the exhaustive code (all ways to part them in two), more get the best of many drawn codes.

Defined results: null texts and texts without a letter are ``und``, score 0, not ambiguous. With one learned language every other text
is that language, score 1; with none it is ``und``. Repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from codegrove.llm import arrays as A
from codegrove.llm import sampling

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the training sample; ``piece`` is the length in bytes of the short extracts trained beside whole texts."""

    per_language: int = 500
    bits: int = 15
    grams: tuple[int, ...] = (1, 2, 3)
    epochs: int = 6
    rate: float = 3.0
    sharpness: float = 30.0
    piece: int = 60
    ambiguous: float = 0.1


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: list[str]
    code: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # language x bit, sums to 1 for each language


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of -1 and 1, any two far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        width = 2 ** (n - 1) - 1
        words = [[1] * width] + [[-1 if (b + 1) >> i & 1 else 1 for b in range(width)] for i in range(n - 1)]
        return np.array(words, dtype=float)
    rng = np.random.default_rng(n)
    width, best, apart = 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        drawn = rng.choice([-1.0, 1.0], (n, width))
        gap = (width - drawn @ drawn.T) / 2 + width * np.eye(n)
        if np.abs(drawn.sum(0)).max() < n and gap.min() > apart:
            best, apart = drawn, gap.min()
    return best if best is not None else rng.choice([-1.0, 1.0], (n, width))


def _buckets(chunk: A.Chunk, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in s.grams:
        g, at = chunk.ngrams(n, n)
        yield (g >> np.uint64(64 - s.bits)).astype(np.int64), at


def _bags(texts: list[str], s: Settings) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Row, distinct buckets and shares of each whole text and of one short extract of it."""
    bags = []
    for chunk in A.chunks(pc.utf8_lower(pa.array(texts, pa.large_string()))):
        families = list(_buckets(chunk, s))
        for r in range(chunk.rows):
            lo, hi = int(chunk.offsets[r]), int(chunk.offsets[r + 1])
            middle = (lo + hi) // 2
            for a, b in {(lo, hi), (max(lo, middle - s.piece // 2), min(hi, middle + s.piece // 2))}:
                own = [f[np.searchsorted(at, a) : np.searchsorted(at, b)] for f, at in families]
                ids, n = np.unique(np.concatenate(own), return_counts=True)
                bags.append((r + chunk.lo, ids, n / max(1, n.sum())))
    return bags


def fit(rows: list[tuple], s: Settings = Settings()) -> Model:
    """Train on (doc_id, text, language) rows."""
    languages = sorted({r[2] for r in rows})
    code = codewords(len(languages))
    width = code.shape[1] if len(languages) else 1
    weights = np.zeros((1 << s.bits, width), dtype=np.float32)
    bias = np.zeros(width)
    if len(languages) < 2:
        return Model(s, languages, code, weights, bias, np.ones((len(languages), width)) / width)
    known = {v: i for i, v in enumerate(languages)}
    target = np.array([known[r[2]] for r in rows])
    bags = _bags([r[1] for r in rows], s)
    rng = np.random.default_rng(11)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(len(bags)):
            row, ids, part = bags[i]
            want = code[target[row]]
            x = s.sharpness * part
            pull = want / (1 + np.exp(np.clip(want * (x @ weights[ids] + bias), -30, 30)))
            weights[ids] += (rate * np.outer(part, pull)).astype(np.float32) * np.float32(s.sharpness / 10)
            bias += 0.01 * rate * pull
    right = np.zeros((len(languages), width))
    seen = np.zeros(len(languages))
    for row, ids, part in bags:
        c = target[row]
        right[c] += np.sign(s.sharpness * part @ weights[ids] + bias) == code[c]
        seen[c] += 1
    trust = np.maximum(right / seen[:, None], 1e-3)
    return Model(s, languages, code, weights, bias, trust / trust.sum(1, keepdims=True))


def predict_texts(texts: pa.Array, m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    n = len(texts)
    best, score, doubt = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=bool)
    lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    if m.languages:
        weights = m.weights.astype(np.float64)
        for chunk in A.chunks(pc.utf8_lower(texts)):
            total, count = np.zeros((chunk.rows, len(m.bias))), np.zeros(chunk.rows)
            families = [(b, np.searchsorted(at, chunk.offsets)) for b, at in _buckets(chunk, m.settings)]
            for r in range(chunk.rows):  # counting by bucket first keeps the product as small for a long text as for a short one
                own = np.concatenate([b[cut[r] : cut[r + 1]] for b, cut in families])
                total[r] = np.bincount(own, minlength=len(weights)) @ weights
                count[r] = len(own)
            f = m.settings.sharpness * total / np.maximum(count, 1)[:, None] + m.bias
            loss = np.log1p(np.exp(-np.clip(f[:, None, :] * m.code[None], -30, 30)))
            distance = (m.trust[None] * loss).sum(2) * m.code.shape[1] / 2
            near = np.exp(distance.min(1, keepdims=True) - distance)
            near /= near.sum(1, keepdims=True)
            part = np.sort(near, axis=1)
            own = slice(chunk.lo, chunk.hi)
            best[own], score[own] = near.argmax(1), part[:, -1]
            if near.shape[1] > 1:
                doubt[own] = part[:, -1] - part[:, -2] < m.settings.ambiguous
    best[~lettered], score[~lettered], doubt[~lettered] = -1, 0.0, False
    score[best < 0] = 0.0
    return [m.languages[b] if b >= 0 else UNKNOWN for b in best.tolist()], score, doubt


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang), at most ``per_language`` of each non-null language."""
    values = sorted(r.lang for r in docs.select("lang").dropna().distinct().collect())
    return fit(sampling.labelled_sample(docs, docs.select("doc_id", "lang"), "lang", values, s.per_language), s)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` of every row of ``docs``."""
    narrow = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, doubt = predict_texts(A.text_column(batch), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(doubt)],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is known and beyond doubt.

    Decisions travel with the row: no join back by id, so null or repeated ids keep their rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, doubt = predict_texts(A.text_column(batch), held.value)
            yield batch.filter(pa.array([n != UNKNOWN and not d for n, d in zip(names, doubt.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
