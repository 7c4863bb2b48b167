"""Phrases against a plain count of all phrases."""

import random
import re
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegrove.llm import phrase_mining as P
from codegrove.llm import queries


def plain(rows, s):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, s.longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= s.support}
        gone = {
            q[i : i + m] for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)
            if 100 * b >= s.percent * found[q[i : i + m]]
        }
        rows = []
        for p, a in found.items():
            if p in gone:
                continue
            cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[: s.top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,shards,support,longest,percent", [(1, 7, 12, 5, 100), (2, 1, 6, 4, 60), (3, 24, 30, 2, 100)])
def test_random_texts(spark, seed, shards, support, longest, percent):
    """Phrases spread evenly, in one shard only, and below the support everywhere."""
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 3 else f"w{i}" for i in range(25)]
    planted = [[rng.choice(vocabulary) for _ in range(5)] for _ in range(6)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 14)):
            words += rng.choice(planted) if rng.random() < 0.3 else [rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""]), i % shards if seed != 1 else (0 if i < 100 else i % shards)))
    rows += [("only here only here " * 20, "en", shards - 1), (None, "en", 0)]
    s = P.Settings(support=support, longest=longest, percent=percent, shards=shards, top=40)
    docs = spark.createDataFrame(rows, "text string, lang string, g int").repartition(4)
    assert found(P.collocations(docs, s, F.col("g"))) == plain([r[:2] for r in rows], s)


def test_awkward(spark, awkward, nothing):
    s = P.Settings(support=2)
    rows = [(r.text, r.lang) for r in awkward.collect()]
    assert found(P.collocations(awkward, s)) == plain(rows, s)
    assert P.collocations(nothing).count() == 0


def test_large_counts_are_exact(spark):
    """a * n * 1000 beyond 64 bits."""
    top = 9000000000001 * 7000000000003 * 1000
    row = spark.sql("SELECT cast(9000000000001 as decimal(38,0)) * cast(7000000000003 as decimal(38,0)) * 1000 AS top, cast(90000000000010007 as decimal(38,0)) AS bottom")
    assert row.selectExpr("top div bottom AS s").first().s == top // 90000000000010007


def test_query_against_plain(spark, documents):
    s = P.Settings()
    want = plain([(r.text, r.lang) for r in documents.collect()], s)
    assert found(queries.QUERIES["op12_phrase_collocations"](spark, "/root/testdata/sf0.001")) == want and want


def test_one_unit_at_a_time(monkeypatch):
    """A task holds one unit: its parts are gone when it is made, and it is gone before the next is."""
    batch = pa.RecordBatch.from_pydict({"text": ["a b c d"] * 8, "lang": ["en"] * 8, "shard": [0] * 8, "need": [1] * 8})
    made, beside = [], []
    real = P.Unit

    def unit(*columns):
        beside.append(sum(u() is not None for u in made))
        own = real(*columns)
        made.append(weakref.ref(own))
        return own

    monkeypatch.setattr(P, "Unit", unit)
    monkeypatch.setattr(P, "UNIT", 16)
    words = type("Sent", (), {"value": np.full(16, 2**64 - 1, dtype=np.uint64)})
    for run in (P._word_rows, P._pair_rows(words), P._longer_rows(words, 4), P._phrase_rows(words, words, 4)):
        made.clear()
        beside.clear()
        assert sum(b.num_rows for b in run(iter([batch] * 4))) > 0
        assert beside == [0] * 4


def test_what_cannot_reach_the_support_is_no_candidate(spark, monkeypatch):
    """A pair that just has one shard's share of the support lacks nine tenths of it."""
    rows = [("a b", "en", i) for i in range(10) for _ in range(10)]
    rows += [("x y", "en", 0)] * 10 + [(w, "en", i) for w in "xy" for i in range(1, 10) for _ in range(10)]
    docs = spark.createDataFrame(rows, "text string, lang string, shard int")
    sizes, real = [], P.Filter.of
    monkeypatch.setattr(P.Filter, "of", staticmethod(lambda keys, n: (sizes.append(keys.distinct().count()), real(keys, n))[1]))
    f, _ = P.counts(docs, P.Settings(support=100, longest=2, shards=10), F.col("shard"))
    assert sorted(tuple(r) for r in f.select("phrase", "f").collect()) == [("a", 100), ("a b", 100), ("b", 100), ("x", 100), ("y", 100)]
    assert sizes == [4, 1]
