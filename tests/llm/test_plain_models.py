"""Scores of the models against plain loops over single texts."""

import math
import re

import numpy as np
import pyarrow as pa

from codegrove.llm import arrays as A
from codegrove.llm import language_codes as lang
from codegrove.llm import quality_model as quality
from codegrove.llm import quality_rules as rules

SF = "/root/testdata/sf0.001"


def one(text, lower=False):
    return A.whole(pa.array([text.lower() if lower else text], pa.large_string()))


def test_folded_quality_table_equals_a_mean_of_features(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents, labels, "quality")
    rows = documents.select("doc_id", "text").collect()
    got = {r.doc_id: r.score for r in quality.score(documents, model).collect()}
    for r in rows:
        total, n = 0.0, 0
        for buckets, _ in quality._features(one(r.text), model.settings):
            for b in buckets.tolist():
                total, n = total + float(model.table[b]), n + 1
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-(total / max(n, 1) + model.bias)))) < 1e-6


def test_decoding_equals_a_loop_over_codewords(documents):
    model = lang.train(documents)
    rows = documents.select("doc_id", "text").collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.predict(documents, model).collect()}
    width = len(model.bias)
    for r in rows[:60]:
        sums, n = [0.0] * width, 0
        for buckets, _ in lang._buckets(one(r.text, lower=True), model.settings):
            for b in buckets.tolist():
                n += 1
                for k in range(width):
                    sums[k] += float(model.weights[b, k])
        bits = [model.settings.sharpness * x / max(n, 1) + model.bias[k] for k, x in enumerate(sums)]
        loss = [
            sum(model.trust[c][k] * math.log1p(math.exp(-max(-30, min(30, bits[k] * model.code[c][k])))) for k in range(width)) * width / 2
            for c in range(len(model.languages))
        ]
        near = [math.exp(min(loss) - x) for x in loss]
        name, score = got[r.doc_id]
        if name != lang.UNKNOWN:
            assert name == model.languages[int(np.argmin(loss))] and abs(score - max(near) / sum(near)) < 1e-6


def test_kept_follows_from_the_printed_rules(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = rules.train(documents, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "quality")
    assert found
    tests = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    printed = [[(n, tests[op], float(v)) for n, op, v in re.findall(r"(\w+) (<=|>=) (-?[\d.]+(?:e[-+]?\d+)?)", str(rule))] for rule in found]
    assert all(len(p) == len(rule.conditions) for p, rule in zip(printed, found))
    values = {r.doc_id: r for r in rules.statistics(documents.select("doc_id", "text")).collect()}
    for r in rules.judge(documents, found).collect():
        first = next((str(rule) for rule, p in zip(found, printed) if all(t(values[r.doc_id][n], v) for n, t, v in p)), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)
