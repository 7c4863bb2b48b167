"""Approximate neighbours against all real distances."""

import numpy as np

from codegrove.operators import vector_cells as N

SF = "/root/testdata/sf0.1"


def exact(v: np.ndarray, ids: np.ndarray, query: int, k: int) -> list[int]:
    s = v @ v[query]
    s[query] = -np.inf
    return ids[np.lexsort((ids, -s))][:k].tolist()


def test_recall_on_the_vectors(spark, monkeypatch):
    # small blocks: cells are dealt out over several tasks, questions as well
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "ASKED", 7)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = N.usable(table, "vec_id", "embedding").persist()
    codes = N.fit(vectors)
    questions = vectors.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    rows = N.neighbours(N.encode(vectors, codes), vectors, questions, codes).collect()
    local = table.orderBy("vec_id").toPandas()
    v = np.stack(local["embedding"].to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = local["vec_id"].to_numpy()
    got: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
        assert abs(r.score - v[np.flatnonzero(ids == r.id)[0]] @ v[np.flatnonzero(ids == r.query_id)[0]]) < 1e-6
    hits = [len(set(got[q]) & set(exact(v, ids, int(np.flatnonzero(ids == q)[0]), 10))) for q in ids[ids % 20 == 0].tolist()]
    recall = sum(hits) / (10 * len(hits))
    print("recall at 10:", recall)
    assert len(hits) == 100 and all(len(g) == 10 for g in got.values()) and recall >= 0.95


def test_awkward_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]
    rows += [(40, None), (41, []), (42, [0.0, 0.0, 0.0]), (43, [1.0, None, 1.0]), (44, [1.0, float("nan"), 1.0]), (45, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "own")
    vectors = N.usable(frame, "own", "embedding")
    codes = N.fit(vectors, cells=4, groups=2)
    assert sorted(r.id for r in N.encode(vectors, codes).collect()) == list(range(40))
    found = N.neighbours(N.encode(vectors, codes), vectors, vectors.withColumnRenamed("id", "query_id"), codes, k=3, probe=4).collect()
    assert len(found) == 120 and all(r.id != r.query_id for r in found)
    # equal vectors come first, ties to the smaller id
    assert [r.id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0][0] == 21
    assert N.fit(vectors.limit(0)) is None
