"""The positional word index: near terms and windows against plain versions, and what a question reads."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from codegrove.operators import ranking as R
from codegrove.sources.word_index import WordIndex, current, typo_budget, variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 16))) for _ in range(900)]
    words += [words[0] * 9, "abcabcabcabcabcabcab", "abcabcabcabcabcabcabx"]
    docs = [(str(i), " ".join(rng.choice(words) for _ in range(30)), rng.choice(words)) for i in range(60)] + [("none", None, "")]
    made = WordIndex(spark, str(tmp_path_factory.mktemp("index")), parts=5)
    made.write(spark.createDataFrame(docs, "id string, content string, name string"), ["content", "name"])
    return made, docs


def test_near_terms_are_complete(spark, index):
    made, docs = index
    terms = {t for _, c, n in docs for t in f"{c or ''} {n}".split()}
    rng = random.Random(8)
    asked = sorted(rng.sample(sorted(terms), 12)) + ["abcab", "bcabcabcabcabcabcabab", "zzzz", "a"]
    got = {(r.word, r.term, r.edits) for r in made.near_terms(asked).collect()}
    budget = lambda w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2
    assert got == {(w, t, distance(w, t)) for w, t in product(asked, terms) if distance(w, t) <= budget(w)}


def test_variants(spark):
    row = spark.range(1).select(variants(F.lit("abc"), F.lit(2)).alias("v"), variants(F.lit("a"), F.lit(1)).alias("w"), typo_budget(F.lit(9)).alias("t")).first()
    assert set(row.v) == {"abc", "ab", "ac", "bc", "a", "b", "c"} and row.w == ["a"] and row.t == 2


def test_windows_and_order(spark, index):
    made, docs = index
    words = [docs[0][1].split()[0], docs[0][1].split()[5], docs[1][2]]
    words = list(dict.fromkeys(words))
    rows = R.best(made.matching(words, typos=False), len(words)).collect()
    want = []
    for i, content, name in docs:
        fields = [(0, (content or "").split()), (1, name.split())]
        met = {w for _, t in fields for w in t if w in words}
        if not met:
            continue
        spans = [
            max(ps) - min(ps) + 1 for _, t in fields for ps in product(*([p for p, x in enumerate(t) if x == w] for w in words))
        ]
        rank = min(f for f, t in fields if met & set(t))
        exact = any(len(t) == len(words) and set(t) == set(words) for _, t in fields)
        want.append((-len(met), 0, min(spans, default=10**9), rank, not exact, i))
    assert [(-r.words, r.typos, 10**9 if r.proximity is None else r.proximity, r.field_rank, not r.exact, r.id) for r in rows] == sorted(want)


def test_a_question_reads_its_folders_only(index):
    made, _ = index
    plan = made.postings(["abcab"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
    ranged = made.terms_from("ab")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,ab)" in ranged and "LessThan(term,ac)" in ranged


def test_suggestions(index):
    made, docs = index
    seen = {}
    for i, content, name in docs:
        for t in set(f"{content or ''} {name}".split()):
            seen[t] = seen.get(t, 0) + 1
    for prefix, limit in (("ab", 7), ("abca", 7), ("a", 60), ("", 5), ("zz", 3)):
        want = sorted(((t, n) for t, n in seen.items() if t.startswith(prefix)), key=lambda x: (-x[1], x[0]))[:limit]
        assert [(r.term, r.documents) for r in made.suggestions(prefix, limit).collect()] == want


def test_built_once_for_each_state(spark, tmp_path):
    source, runs = str(tmp_path / "t"), []
    spark.range(3).write.parquet(source)

    def build(path):
        runs.append(path)
        spark.range(1).write.parquet(f"{path}/x")

    first = current(spark, "probe", [source], build)
    assert current(spark, "probe", [source], build) == first and len(runs) == 1
    spark.range(4).write.mode("overwrite").parquet(source)
    assert current(spark, "probe", [source], build) != first and len(runs) == 2
    assert spark.read.parquet(f"{first}/x").count() == 1


def test_a_term_has_three_keys_at_most_and_repeated_ids_are_one_document(spark, tmp_path):
    docs = [("a", "letters letters apart", "x"), ("a", "letters apart letters", "x"), (None, "letters", ""), (None, "apart", ""), ("b", "abcdefghijklmnopq", "x")]
    made = WordIndex(spark, str(tmp_path / "index"), parts=3)
    made.write(spark.createDataFrame(docs, "id string, content string, name string"), ["content", "name"])
    keys = spark.read.parquet(f"{made.path}/near").groupBy("term").count().collect()
    assert {r.term: r["count"] for r in keys} == {"letters": 3, "apart": 2, "x": 1, "abcdefghijklmnopq": 3}
    assert {(r.term, r.documents, r.occurrences) for r in made.terms_from("").collect()} == {
        ("letters", 2, 5), ("apart", 2, 3), ("x", 2, 3), ("abcdefghijklmnopq", 1, 1)
    }
    got = {(r.id, r.field, tuple(r.positions), r.length) for r in made.postings(["letters"]).collect()}
    assert got == {("a", "content", (0, 0, 1, 2), 3), (None, "content", (0,), 1)}
