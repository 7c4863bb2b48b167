import zlib

import numpy as np
import pyarrow as pa
import pytest

from codegrove.llm import language_codes as lang
from codegrove.llm import quality_model as quality
from codegrove.llm import quality_rules as rules
from codegrove.llm import toxicity_crf as crf
from codegrove.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held(doc_id, parts, remainder):
    return zlib.crc32(str(doc_id).encode()) % parts == remainder


def area(y, s):
    """Share of (positive, negative) pairs in the right order."""
    y, s = np.array(y), np.array(s)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])).mean()


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_on_held_out_documents(spark, labels):
    rows = QUERIES["op2_subword_quality"](spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [(labels[r.doc_id].quality, r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert area(*zip(*own)) > 0.95


def test_toxicity_on_held_out_documents(spark, labels):
    rows = QUERIES["op10_toxicity_crf"](spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [(labels[r.doc_id].toxic, r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert area(*zip(*own)) > 0.8
    spans = [s for r in rows for s in r.spans]
    assert spans and all(0 <= s.start < s.end and 0.5 <= s.score <= 1 for s in spans)


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op9_language_codes"](spark, SF).collect()
    own = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean(own) > 0.97


@pytest.mark.parametrize("n", [2, 4, 6, 9])
def test_codewords_lie_apart(n):
    code = lang.codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(gaps) >= max(1, code.shape[1] // 4)


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 127, 128, 129, 0, 600])
    scores, moves, start = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    want, at = [], 0
    for c in counts:
        e = np.stack([np.ones(c), np.exp(scores[at : at + c])], 1)
        at += c
        if not c:
            continue
        a, b = np.zeros((c, 2)), np.ones((c, 2))
        a[0] = np.exp(start) * e[0]
        for t in range(1, c):
            a[t] = (a[t - 1] @ np.exp(moves)) * e[t]
            a[t] /= a[t].sum()
        for t in range(c - 2, -1, -1):
            b[t] = np.exp(moves) @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = a * b
        want.append(p[:, 1] / p.sum(1))
    assert np.allclose(crf.marginals(scores, counts, moves, start), np.concatenate(want), atol=1e-9)


def test_spans_give_the_words(spark):
    rng = np.random.default_rng(0)
    words = ["Über", *("".join(rng.choice(list("bcdfgklmoprtu"), 6)) for _ in range(800))]
    clean = [" ".join(rng.choice(words, 30)) for _ in range(60)]
    toxic = [t[: len(t) // 2].rsplit(" ", 1)[0] + " nasty " + t[len(t) // 2 :].split(" ", 1)[1] for t in clean]
    model = crf.fit([(i, t, k) for k, texts in enumerate((clean, toxic)) for i, t in enumerate(texts)], 0.5)
    scores, spans = crf.tag_texts(pa.array([toxic[0], clean[0], "", "İİ É nasty"], pa.large_string()), model)
    assert scores[0] > 0.5 > scores[1]
    assert [toxic[0][s["start"] : s["end"]] for s in spans[0]] == ["nasty"] and spans[1] == [] and spans[2] == []
    assert ["İİ É nasty"[s["start"] : s["end"]] for s in spans[3]] == ["nasty"]


def test_rules_are_found_and_cut_back():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = (x[:, 0] > 0.8) & (x[:, 3] < 0.5)
    found = rules.learn(x, bad, list(range(3000)))
    hit = np.zeros(3000, dtype=bool)
    for rule in found:
        own = np.ones(3000, dtype=bool)
        for name, sign, value in rule.conditions:
            column = x[:, rules.FEATURES.index(name)]
            own &= column >= value if sign == ">=" else column <= value
        hit |= own
    assert (hit == bad).mean() > 0.98


def test_rule_statistics_equal_brute_force(spark):
    import re
    from collections import Counter

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_decision_list"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_rules_stay_in_the_jvm(spark, documents):
    plan = rules.judge(documents, [rules.Rule((("symbols_per_word", ">=", 0.5),))])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 0), (8, 1)], "doc_id long, quality int").withColumn("toxic", 1 - __import__("pyspark").sql.functions.col("quality"))
    q = quality.train(awkward, labels, "quality")
    c = crf.train(awkward, labels, "toxic")
    g = lang.train(awkward)
    for frame, n in ((awkward, 12), (nothing, 0)):
        assert len(quality.score(frame, q).collect()) == n
        assert all(0 <= r.score <= 1 for r in crf.tag(frame, c).collect())
        assert len(rules.judge(frame, []).collect()) == n
        found = {(r.doc_id, r.lang_pred) for r in lang.predict(frame, g).collect()}
        assert {(1, "und"), (2, "und"), (3, "und"), (5, "und")} <= found or n == 0
        kept = lang.accepted(frame, g)
        assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 5})
    # nothing to learn from
    for label in ("quality", "toxic"):
        module = quality if label == "quality" else crf
        model = module.train(nothing, labels.limit(0), label)
        frame = quality.score(awkward, model) if label == "quality" else crf.tag(awkward, model)
        assert all(abs(r.score - 0.5) < 1e-6 for r in frame.collect())
    assert {r.lang_pred for r in lang.predict(awkward, lang.train(nothing)).collect()} == {"und"}
    assert rules.train(nothing, labels.limit(0)) == []
