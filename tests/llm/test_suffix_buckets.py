"""Repeated strings against a plain count of all strings of that length."""

import hashlib
import random
from collections import Counter

import pytest

from codegrove.llm import queries
from codegrove.llm import suffix_buckets as S


def plain(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def check(spark, rows, s):
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = sorted(
        (str(r.doc_id), r.text or "", r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_)) for r in S.remove_repeats(docs, s).collect()
    )
    want = sorted((str(r[0]), r[1] or "", *w) for r, w in zip(rows, plain([r[1] for r in rows], s.length)))
    assert got == want


@pytest.mark.parametrize("seed,length,gram,fan", [(1, 20, 7, 3), (2, 12, 5, 2), (3, 30, 30, 4), (4, 40, 1, 5)])
def test_random_texts(spark, seed, length, gram, fan):
    """Texts made of shared parts with edits, over a small alphabet, so that many strings nearly repeat."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice("xyzäb") * rng.randint(1, 4) for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.3 and text:
            k = rng.randrange(len(text))
            text = text[:k] + "Q" + text[k + 1 :]
        rows.append((rng.choice([i, 5, None]), text, "x"))
    check(spark, rows, S.Settings(length, gram, fan))


def test_periods_ties_and_repeated_rows(spark):
    rows = [
        (1, "a" * 500, "x"), (2, "ab" * 70, "x"), (2, "ab" * 70, "x"), (None, None, None), (3, "", None), (None, "b" + "ab" * 70, "x"),
        (4, "a" * 199, "x"), (5, "é" * 100, "x"), (6, "é" * 100 + "z", "x"), (7, "x" + "a" * 200, "x"),
    ]
    check(spark, rows, S.Settings())


def test_one_frequent_passage_in_different_surroundings(spark):
    """Hundreds of places share a passage a little shorter, as long as, or longer than the length."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = word(260)
    rows = [(i, word(150) + p[: rng.choice([150, 199, 200, 230, 260])] + word(150), "x") for i in range(300)]
    check(spark, rows, S.Settings())


def test_awkward(spark, awkward, nothing):
    got = S.remove_repeats(awkward)
    assert got.columns == [*awkward.columns, "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    rows = got.collect()
    want = plain([r.text for r in rows], 200)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == want and len(rows) == awkward.count()
    assert S.remove_repeats(nothing).count() == 0


def test_query_against_plain(spark, documents):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_suffix_buckets"](spark, "/root/testdata/sf0.001").collect()}
    docs = documents.collect()
    for d, (n, gone, spans, kept) in zip(docs, plain([d.text for d in docs], 200)):
        r = rows[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in rows.values()) > 0
