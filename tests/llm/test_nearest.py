"""Nearest neighbours: exact scores, ties, odd vectors, and recall against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import nearest

QUERY = "vec_id % 20 = 0"


def brute_force(rows: dict[int, list], k: int):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids.tolist()], "f8")
    for q in ids[ids % 20 == 0]:
        score = np.zeros(len(ids))
        for j in range(x.shape[1]):
            score += x[ids == q][0, j] * x[:, j]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        yield from ((int(q), r, int(ids[i]), float(score[i])) for r, i in enumerate(order, 1))


def test_recall_and_exact_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = {(q, v): s for q, _, v, s in brute_force({r["vec_id"]: r["embedding"] for r in docs.collect()}, 20)}
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest.search(docs, QUERY).collect()}
    assert len(found) == len(want) and len(found.keys() & want.keys()) >= 0.9 * len(want)
    assert all(found[p] == want[p] for p in found.keys() & want.keys())


@pytest.mark.parametrize("kind", ["even", "uneven", "very uneven", "clusters"])
def test_recall_of_large_batches(spark, kind):
    """10,000 vectors in one batch, whatever their norms, by the parameters of the query."""
    r = np.random.default_rng(3)
    x = r.normal(size=(10_000, 64))
    if kind == "clusters":
        x = r.normal(size=(50, 64))[r.integers(0, 50, 10_000)] + 0.3 * x
    x = (x * r.lognormal(0, {"uneven": 0.5, "very uneven": 1.0}.get(kind, 0.0), (10_000, 1))).astype("f4")
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    wide = x.astype("f8")
    scores = wide[::20] @ wide.T
    scores[np.arange(500), np.arange(0, 10_000, 20)] = -np.inf
    want = {(20 * q, v) for q, row in enumerate(np.argsort(-scores, axis=1)[:, :20].tolist()) for v in row}
    found = nearest.search(docs, QUERY).collect()
    assert len(found) == 20 * 500 and len({(row["query_id"], row["vec_id"]) for row in found} & want) >= 0.95 * len(want)


def test_odd_vectors_and_ties(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]), (8, [2.0, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (9, [1.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label string")
    found = sorted(map(tuple, nearest.search(docs, QUERY).collect()))
    live = {i: v for i, v in rows if i in (0, 1, 2, 8, 20)}
    assert found == list(brute_force(live, 20))


def test_many_copies_push_nothing_out(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(300 + i, [2.0, i / 8]) for i in range(30)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    assert sorted(map(tuple, nearest.search(docs, QUERY, rerank=40).collect())) == list(brute_force(dict(rows), 20))


def test_blocks_of_queries(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = sorted(map(tuple, nearest.search(docs, QUERY).collect()))
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, nearest.search(docs, QUERY).collect())) == one


def test_parallel_errors_weigh_more():
    assert nearest.parallel_weight(64) == pytest.approx(63 * 0.04 / 0.96)
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 32))

    def parallel(threshold):
        centres, extra = nearest.fit(x, threshold)
        codes = nearest.encode(x, centres, extra)
        chosen = np.stack([centres[m, codes[:, m]] for m in range(codes.shape[1])], 1).reshape(len(x), -1)
        return np.mean((((x - chosen) * x).sum(1)) ** 2 / (x * x).sum(1))

    assert parallel(0.5) < parallel(0.0)


def test_empty(spark):
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), QUERY).count() == 0


@pytest.mark.parametrize("vec_id", range(6))
def test_one_id_repeated_beyond_the_sample(spark, vec_id):
    rows = [(vec_id, [1.0, 2.0, 3.0])] * 10
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = nearest.search(vectors, F.lit(True), sample=2).collect()
    assert found == []  # every other row has the query's own id
    other = spark.createDataFrame([*rows, (100, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.search(other, F.col("vec_id") == 100, sample=2).collect()] == [(100, k, vec_id, 1.0) for k in range(1, 11)]
