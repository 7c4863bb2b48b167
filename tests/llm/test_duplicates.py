import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from codegrove.llm import arrays, bag_minhash, line_dedup, neighbours, passage_chains
from codegrove.llm.queries import ORACLES, QUERIES
from codegrove.staging import Stage

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


class Sets:
    """Plain union-find."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def weighted(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def copies(rng, base, n, edits):
    out = []
    for i in range(n):
        words = base[:]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def families():
    """Texts around the threshold: a group of near copies that are only partly similar to each other, exact copies, and others."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    other = [f"v{rng.randint(0, 50)}" for _ in range(120)] * 2
    texts = copies(rng, base, 60, 3) + copies(rng, base, 30, 1) + copies(rng, other, 20, 2) + [" ".join(base)] * 15
    return list(enumerate(texts + [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(80)) for _ in range(20)]))


def test_signatures_estimate_the_weighted_index(families):
    texts = pa.array([t for _, t in families], pa.large_string())
    chunk = arrays.whole(texts)
    signed = bag_minhash.signatures(*bag_minhash.bags(chunk, 5), chunk.rows, 3000)
    for i, j in ((0, 1), (0, 70), (60, 61), (90, 91), (90, 92), (0, 129)):
        true = weighted(bag(texts[i].as_py()), bag(texts[j].as_py()))
        assert abs((signed[i] == signed[j]).mean() - true) < 0.04
        assert abs(bag_minhash.overlaps(texts.slice(i, 1), texts.slice(j, 1), 5)[0] - true) < 1e-12


def test_near_classes_equal_brute_force(spark, families):
    docs = spark.createDataFrame(families, "doc_id long, text string")
    bags = {d: bag(t) for d, t in families}
    sets = Sets(bags)
    for a in bags:
        for b in range(a):
            if weighted(bags[a], bags[b]) >= 0.8:
                sets.join(a, b)
    got = {r.doc_id: r.class_id for r in bag_minhash.classify(docs).collect()}
    assert got == {d: sets.find(d) for d in bags}
    stay = bag_minhash.keep_one(docs.withColumn("key", docs.doc_id)).collect()
    assert sorted(r.doc_id for r in stay) == sorted({sets.find(d) for d in bags}) and all(r.key == r.doc_id for r in stay)


def test_near_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bags = {d: bag(t) for d, t in docs.items()}
    sets = Sets(docs)
    for a in docs:
        for b in docs:
            if b < a and weighted(bags[a], bags[b]) >= 0.8:
                sets.join(a, b)
    assert {r.doc_id: r.class_id for r in QUERIES["op1_bag_minhash"](spark, SF).collect()} == {d: sets.find(d) for d in docs}


def test_wide_buckets_lose_no_pair(spark):
    """All keys of one bucket, in many chunks: everything outside the largest component meets everything of another one."""
    rng = random.Random(2)
    texts = {k: "".join(rng.choice("abcdef") for _ in range(12)) for k in range(1, 200)}
    texts |= {k: texts[k - 300] for k in range(300, 330) if k - 300 in texts}
    keys = np.array(sorted(texts), dtype=np.uint64)

    def rows(batches):
        for _ in batches:
            for part in np.array_split(keys, 7):
                yield from neighbours.bucket_rows(part, np.full((len(part), 1), 5, dtype=np.uint64))

    def similar(left, right):
        return np.array([a == b for a, b in zip(left.to_pylist(), right.to_pylist())])

    def counts(found):
        features = [np.frombuffer(t.encode(), dtype=np.uint8) for t in found.to_pylist()]
        of = np.repeat(np.arange(len(features)), [len(f) for f in features])
        return neighbours.count_places(len(features), of, np.concatenate(features).astype(np.uint64), np.ones(len(of)))

    table = spark.createDataFrame(list(texts.items()), "key long, text string")
    dealt = spark.range(1).coalesce(1).mapInArrow(rows, neighbours.BUCKETS)
    got = neighbours.classes(Stage(spark, "test"), dealt, lambda k, n: table.join(k, "key", "left_semi"), similar, counts, 1.0)
    assert {r.key: r.root for r in got.collect()} == {k: k % 300 for k in texts for k in (k % 300, k) if k % 300 + 300 in texts}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links += [(rng.randint(5000, 5100), rng.randint(5000, 5100)) for _ in range(80)] + [(7, 7)]
    sets = Sets({i for link in links for i in link})
    for a, b in links:
        sets.join(a, b)
    got = neighbours.connected(Stage(spark, "test"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.key: r.root for r in got} == {i: sets.find(i) for a, b in links if a != b for i in (a, b)}
    assert neighbours.connected(Stage(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def lines_that_stay(docs):
    """Brute force: (document, line) of the lines with a word that stay, and all of them."""
    first, places = {}, set()
    for d in sorted(docs):
        for i, line in enumerate(docs[d].split("\n")):
            k = line.lower().strip(SPACES)
            if k:
                places.add((d, i))
                first.setdefault(k, (d, i))
    grams = {k: {k[i : i + 7] for i in range(len(k) - 6)} for k in first}
    having = defaultdict(set)
    for k, own in grams.items():
        for g in own:
            having[g].add(k)
    sets = Sets(first)
    for k, own in grams.items():
        for c in {c for g in own for c in having[g] if c < k}:
            both = len(own & grams[c])
            if both >= 0.8 * (len(own) + len(grams[c]) - both):
                sets.join(k, c)
    groups = defaultdict(list)
    for k in first:
        groups[sets.find(k)].append(first[k])
    return {min(g) for g in groups.values()}, places


def without_lines(text, d, stay, places):
    return "\n".join(line for i, line in enumerate(text.split("\n")) if (d, i) not in places or (d, i) in stay)


def test_lines_equal_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs |= {10**6: "Keep THIS line, please do.\n\n  keep this line, please do.  \nÉtendue de la ligne numéro un\nÉtendue de la ligne numéro un!\nok\nOK"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    stay, places = lines_that_stay(docs)
    rows = line_dedup.dedup_lines(frame).collect()
    wrong = [r.doc_id for r in rows if r.text != without_lines(docs[r.doc_id], r.doc_id, stay, places)]
    assert len(rows) == len(docs) and len(wrong) <= 1  # a pair at the threshold is found with probability 0.985
    assert {r.doc_id: r.text for r in rows}[10**6] == "Keep THIS line, please do.\n\nÉtendue de la ligne numéro un\nok"


def test_lines_of_awkward_rows(spark, awkward, nothing):
    rows = line_dedup.dedup_lines(awkward).collect()
    assert len(rows) == 12
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert texts[1] == [None] and texts[2] == [""] and texts[3] == [" \t\n "] and texts[6] == ["the same line"] * 2
    assert all(r.key == 7 and r.row_key == "x" for r in rows)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_near_classes_of_awkward_rows(spark, awkward, nothing):
    got = Counter((r.doc_id, r.class_id) for r in bag_minhash.classify(awkward).collect())
    assert got == Counter({(d, d): n for d, n in Counter(r.doc_id for r in awkward.collect()).items()})
    stay = bag_minhash.keep_one(awkward)
    assert stay.columns == awkward.columns and Counter(r.doc_id for r in stay.collect())[6] == 1 and stay.count() == 11
    assert bag_minhash.classify(nothing).count() == 0 and bag_minhash.keep_one(nothing).count() == 0


def words_of(text):
    return re.findall(rf"[^{SPACES}]+", (text or "").lower())


def test_passages_cover_all_repeats(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_passage_chains"](spark, sf).collect()
    covered = defaultdict(set)
    for r in rows:
        covered[r.doc_id].update(range(r.start_word, r.end_word))
        a, b = docs[r.doc_id][r.start_word : r.end_word], docs[r.other_doc_id][r.other_start_word : r.other_end_word]
        assert r.other_doc_id <= r.doc_id and len(a) >= 50
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert abs(row[-1] / max(len(a), len(b)) - r.similarity) < 1e-9 and r.similarity >= 0.8
    seen = set()
    for d in sorted(docs):
        for i in range(len(docs[d]) - 49):
            window = tuple(docs[d][i : i + 50])
            if window in seen:
                assert covered[d].issuperset(range(i, i + 50))
            seen.add(window)


def test_planted_passages(spark, awkward, nothing):
    rng = random.Random(3)
    new = lambda n: [f"x{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, short = new(60), new(45)
    fuzzy = passage[:20] + new(2) + passage[22:41] + passage[43:]
    docs = [(1, new(30) + passage + new(10)), (2, new(100)), (3, passage), (4, new(20) + fuzzy + new(40)), (5, short + new(9)), (6, new(9) + short)]
    frame = spark.createDataFrame([(d, " ".join(w), 0) for d, w in docs], "doc_id long, text string, key int")
    rows = passage_chains.passages(frame).collect()
    assert {r.doc_id for r in rows} == {3, 4}
    kept = {r.doc_id: r.text.split() for r in passage_chains.remove_passages(frame).collect()}
    assert kept[3] == [] and kept[4] == docs[3][1][:20] + docs[3][1][-40:] and kept[2] == docs[1][1] and kept[1] == docs[0][1]
    assert passage_chains.passages(nothing).count() == 0 and passage_chains.remove_passages(nothing).count() == 0
    out = passage_chains.remove_passages(awkward)
    assert out.columns == awkward.columns and out.count() == 12 and out.filter("text is null").count() == 1


def test_chains_equal_brute_force():
    s = passage_chains.Settings(gap_cost=0.3)
    rng = np.random.default_rng(8)
    for _ in range(40):
        x, y = rng.integers(0, 60, 25), rng.integers(0, 60, 25)
        order = np.lexsort((y, x))
        best = {}
        for i in order:
            best[i] = float(s.words)
            for j in best:
                if x[j] < x[i] and y[j] < y[i]:
                    dx, dy = int(x[i] - x[j]), int(y[i] - y[j])
                    best[i] = max(best[i], best[j] + min(s.words, dx, dy) - s.gap_cost * (max(0, dx - s.words) + max(0, dy - s.words)))
        paths = passage_chains.chains(x, y, s)
        assert sorted(i for p in paths for i in p.tolist()) == list(range(25))
        for p in paths:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(p, p[1:]))


def test_top_k_equals_sql_and_handles_odd_vectors(spark):
    from oracle import canonical, duck

    from codegrove.llm.topk_search import top_k
    from pyspark.sql import functions as F

    for sf in (SF, "/root/testdata/sf0.1"):
        got, cur = QUERIES["op6_columnar_topk"](spark, sf), duck(sf).execute(ORACLES["op6_columnar_topk"])
        assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [0.5, nan]), (1, None), (2, []), (3, [1.0, None]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1e12, 1e12]), (None, [1.0, 1.0]), (100, [9.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = [tuple(r) for r in top_k(frame, F.col("vec_id") % 50 == 0, 2).orderBy("query_id", "rank").collect()]
    big = 256 * 10**12
    assert found == [(0, 1, 7, 256 * big + 512 * big), (0, 2, 5, 256 * 256 + 512 * 512)]
    assert top_k(frame.limit(0), F.col("vec_id") % 50 == 0, 2).count() == 0
    # blocks meet by a shuffle, whatever Spark takes their size for
    assert "Broadcast" not in top_k(frame, F.col("vec_id") % 50 == 0, 2)._jdf.queryExecution().executedPlan().toString()


def test_pipeline_stages_take_effect(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "MinHash near-dedup", "substring dedup", "best-fit packing"]
    stage = Stage(spark, "test-pipeline")
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = stage.table(step(spark, before, SF))
        assert after.columns == docs.columns and after.count() <= before.count()
        if name == "line dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            stay, places = lines_that_stay(texts)
            want = {d: without_lines(t, d, stay, places) for d, t in texts.items()}
            got = {r.doc_id: r.text for r in after.collect()}
            assert sum(got.get(d, "").strip() != t.strip() for d, t in want.items()) <= 1
        if name == "MinHash near-dedup":
            bags = [bag(r.text) for r in after.collect()]
            assert all(weighted(a, b) < 0.8 for i, a in enumerate(bags) for b in bags[:i])
        before = after
    assert passage_chains.passages(before).count() == 0
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in before.collect()}
    for _, step in corpus_pipeline.STAGES:
        step(spark, awkward, SF).count()
        step(spark, awkward.limit(0), SF).count()


def test_frequent_halves_do_not_hide_a_verbatim_passage(spark):
    rng = random.Random(11)
    new = lambda n: [f"x{rng.randint(0, 10**9)}" for _ in range(n)]
    one, two = new(30), new(30)
    docs = {d: new(40) + one + new(40) for d in (1, 4, 5, 6)} | {d: new(40) + two + new(40) for d in (2, 7, 8, 9)}
    docs |= {3: new(20) + one + two + new(20), 10: new(33) + one + two + new(7)}
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    for parts in (1, 10):  # all in one chunk, and dealt out
        rows = passage_chains.passages(frame.repartition(parts)).collect()
        assert [(r.doc_id, r.start_word, r.end_word, r.other_doc_id, r.other_start_word, r.similarity) for r in rows] == [(10, 33, 93, 3, 20, 1.0)]


def test_chains_of_unlike_passages_are_cut_at_their_gaps(spark):
    rng = random.Random(12)
    new = lambda n: [f"x{rng.randint(0, 10**9)}" for _ in range(n)]
    one, two, short = new(50), new(50), new(25)
    before = {1: new(9) + one + new(28) + two + new(9), 2: new(9) + two + new(4) + one + short + new(9)}
    after = {3: new(30) + one + new(28) + two + new(5), 4: one + two, 5: new(3) + one + new(20) + short}
    for later, text in after.items():
        docs = {1: before[1] if later < 5 else before[2], later: text}
        frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
        kept = {r.doc_id: r.text.split() for r in passage_chains.remove_passages(frame).collect()}
        assert not {*one, *two} & {*kept[later]} if later < 5 else kept[5] == text[:3] + text[53:]


def test_parts_of_a_chain():
    # two stretches of 50 words with 30 other words between them; a part keeps the words that are equal beyond its matches
    s = passage_chains.Settings()
    a, b = [*range(130)], [*range(50), *range(1000, 1030), *range(80, 130)]
    xs = [3, 10, 20, 33, 44, 82, 90, 101, 110, 120]
    found = sorted(passage_chains.similar_parts(a, xs, b, xs, s))
    assert found == [(0, 50, 0, 50, 1.0), (80, 130, 80, 130, 1.0)]


def test_fuzzy_recall_by_edit_rate(spark):
    rng = random.Random(21)
    new = lambda n: [f"x{rng.randint(0, 10**9)}" for _ in range(n)]
    docs, case, number = [], {}, 0
    for length in (60, 100, 200):
        for rate in (0.03, 0.05, 0.1, 0.15):
            for _ in range(40):
                passage = new(length)
                changed = [w if rng.random() > rate else new(1)[0] for w in passage]
                if sum(x == y for x, y in zip(passage, changed)) >= 0.8 * length:
                    number += 1
                    docs += [(2 * number, new(70) + passage + new(90)), (2 * number + 1, new(80) + changed + new(80))]
                    case[2 * number + 1] = (length, rate)
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    rows = passage_chains.passages(frame).collect()
    assert all(r.other_doc_id == r.doc_id - 1 and r.similarity >= 0.8 for r in rows)
    found = {r.doc_id for r in rows}
    recall = {c: np.mean([d in found for d, own in case.items() if own == c]) for c in sorted(set(case.values()))}
    print(recall)
    # passages that share fewer than two seeds are not compared: short ones with many changes
    least = {(60, 0.1): 0.65, (60, 0.15): 0.5, (100, 0.15): 0.8}
    assert all(r >= least.get(c, 0.9) for c, r in recall.items())


def test_frequent_seeds_do_not_hide_a_changed_passage(spark):
    """Every seed of the passage is more frequent than seeds are matched at once, before and after the only place that has the whole of it."""
    rng = np.random.default_rng(5)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = new(90)
    changed = [new(1)[0] if i % 30 == 14 else w for i, w in enumerate(passage)]
    parts = [passage[i : i + 30] for i in (0, 15, 30, 45, 60)]
    pieces = lambda first: [(first + i, new(40) + parts[i % 5] + new(40)) for i in range(30)]
    docs = [*pieces(0), (40, new(50) + passage + new(50)), *pieces(50), (90, new(60) + changed + new(20))]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    for n in (1, 7):
        rows = [r for r in passage_chains.passages(frame.repartition(n)).collect() if r.doc_id == 90]
        assert [(r.other_doc_id, r.start_word <= 65, r.end_word >= 145) for r in rows] == [(40, True, True)]


def test_links_of_large_groups_all_meet(spark, monkeypatch):
    """Places of a link are dealt into a grid; each open one meets every earlier one, once."""
    rng = np.random.default_rng(6)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = new(60)
    docs = [(i, new(30) + passage + new(30)) for i in range(40)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    keyed = frame.withColumn("key", passage_chains.row_key())
    s, seen = passage_chains.Settings(), []
    seeds = [(k, w) for k in (r.key for r in keyed.collect()) for w in (35, 50, 70)]
    marks = spark.createDataFrame(seeds, "key long, word int")
    none = spark.createDataFrame([], "key long, a long, b long")
    for block in (1024, 7):
        monkeypatch.setattr(passage_chains, "BLOCK", block)
        found = passage_chains._open_matches(keyed, marks, none, Stage(spark, "test"), s)
        seen.append(sorted(tuple(r) for r in found.distinct().collect()))
    assert len(seen[0]) == 3 * 40 * 39 // 2 and seen[0] == seen[1]


def test_reach_of_many_pairs_is_that_of_extend():
    rng = np.random.default_rng(7)
    s, size = passage_chains.Settings(), passage_chains.AROUND
    texts = rng.integers(0, 12, (400, 60)).astype(np.int32)
    texts[200:, 5:] = texts[:200, 3:58]
    lengths = rng.integers(0, 60, 400)
    n = np.minimum(lengths, size)
    sides = []
    for nothing in passage_chains._NOTHING:
        wide = np.full((400, size + 4), nothing)
        for r in range(400):
            wide[r, : n[r]] = texts[r, : n[r]]
        sides.append(wide)
    a, b = rng.integers(0, 400, 5000), rng.integers(0, 400, 5000)
    b[:400], a[:400] = np.arange(400), (np.arange(400) + 200) % 400
    got = passage_chains._reach(sides[0], n, sides[1], n, a, b, s)
    want = [passage_chains.extend(texts[i, : lengths[i]].tolist(), 0, texts[k, : lengths[k]].tolist(), 0, 1, 2.0, s)[0] for i, k in zip(a, b)]
    told = got < s.least
    assert told.sum() > 1000 and (got[told] == np.array(want)[told]).all()
    assert (~told).sum() > 100
