import numpy as np
from pyspark.sql import functions as F

from lectern.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def brute(rows, queries, k):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)
        out[q] = d[:k]
    return out


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16)) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(500)]  # one very common vector
    queries = [0, 100, 200, 700, 5000, 5400]
    got = {}
    out = ann.nearest(frame(spark, rows), F.col("id").isin(queries), sampled=1000, block=256, together=2)
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute(rows, queries, 10)
    assert set(got) == set(queries) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in queries)
    assert hits >= 0.9 * 10 * len(queries)
    exact = {(q, i): s for q in queries for s, i in brute(rows, [q], 10**9)[q]}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in queries for s, i in got[q])
    assert [i for _, i in got[5400]] == [7, *range(5000, 5009)]  # equal distances: the smaller ids


def test_recall_on_the_given_vectors(spark):
    import os

    import pytest

    if not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"):
        pytest.skip("no tables here")
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect() if r["embedding"] is not None and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    got = {}
    for r in ann.nearest(e, F.expr("id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = 0
    for q, found in got.items():
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and hits >= 0.95 * 10 * len(got), hits / len(got) / 10


def test_few_vectors_in_the_probed_lists(spark):
    rng = np.random.default_rng(4)
    far = [(i, rng.normal(size=8) * 0.01 + 1000 * np.eye(8)[i % 8]) for i in range(40)]
    alone = [(1000, np.full(8, -500.0))]
    rows = ann.nearest(frame(spark, far + alone), F.col("id") >= 0, k=10, lists=9, sampled=1000, parts=4, target=0.1).collect()
    counts = {}
    for r in rows:
        counts[r["query_id"]] = counts.get(r["query_id"], 0) + 1
    assert set(counts) == {i for i, _ in far + alone} and set(counts.values()) == {10}


def test_clashing_columns(spark):
    rows = frame(spark, [(i, [i, 1.0]) for i in range(1, 30)]).select("vec_id", "embedding", *(F.lit("own").alias(c) for c in ("id", "v", "list", "rank", "query_id", "block", "codes")))
    got = ann.nearest(rows, F.expr("id = 5"), k=2).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(5, 1, 4), (5, 2, 6)]


def test_odd_input(spark):
    rows = [(1, [1, 0]), (2, [0, 1]), (3, None), (4, [0, 0]), (5, [1, None]), (6, [float("nan"), 1]), (7, [float("inf"), 1]), (8, [1, 2, 3]), (2, [0, 1]), (None, [1, 1])]
    got = ann.nearest(frame(spark, rows), F.lit(True)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(1, 1, 2), (2, 1, 1)}
    assert ann.nearest(frame(spark, []), F.lit(True)).count() == 0
    assert ann.nearest(frame(spark, [(1, [1, 2])]), F.lit(True)).count() == 0
