"""Vector searches against brute force, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bitsliced, kmeans_tree

SCHEMA = "vec_id long, embedding array<float>, label int, x string, leaf string, block string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", "c", "c", "c") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    nan, inf = float("nan"), float("inf")
    return table(spark, [(0, None), (50, [0.0, 0.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (100, [0.5, 0.5]), (4, [0.5, 0.5]), (4, [0.5, 0.5]), (5, [-0.25, 0.75]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (150, [1e-30, -1e-30])])


def brute(ids, scores, queries, k):
    out = {}
    for q in queries:
        rows = sorted((-scores[q][j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])
        out[ids[q]] = [(v, -s) for s, v in rows[:k]]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [64, 4096])
def test_bit_sliced_products(spark, monkeypatch, block):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 6)) * 2, 1).astype(np.float32)
    df = table(spark, [(i, x[i].tolist()) for i in range(400)])
    got = grouped(bitsliced.top_products(df, df.filter("vec_id % 50 = 0"), 5).collect())
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    s = q @ q.T
    assert got == brute(list(range(400)), s, range(0, 400, 50), 5)


def test_bit_sliced_ties_and_edges(spark, odd):
    got = grouped(bitsliced.top_products(odd, odd.filter("vec_id % 50 = 0"), 5).collect())
    assert got[100] == [(4, 32768), (4, 32768), (5, 16384), (50, 0), (150, -128)] and set(got) == {50, 100, 150}
    assert bitsliced.top_products(odd.limit(0), odd, 5).count() == 0
    same = table(spark, [(i, [0.5, 0.25]) for i in range(70)])
    assert [v for v, _ in grouped(bitsliced.top_products(same, same.filter("vec_id = 3"), 5).collect())[3]] == [0, 1, 2, 4, 5]
    with pytest.raises(Exception, match="components beyond"):
        bitsliced.top_products(table(spark, [(0, [1e9])]), table(spark, [(0, [1e9])]), 1).collect()


def test_kmeans_tree_recall(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "CHUNK_ROWS", 100)
    monkeypatch.setattr(kmeans_tree, "CHUNK_QUERIES", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    df = table(spark, [(i, x[i].tolist()) for i in range(3000)])
    got = grouped(kmeans_tree.nearest(df, F.col("vec_id") % 50 == 0, 5).collect())
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = brute(list(range(3000)), u @ u.T, range(0, 3000, 50), 5)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, rows in got.items():
        assert len(rows) == 5 and all(abs(s - u[q] @ u[v]) < 1e-12 for v, s in rows) and rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_kmeans_tree_edges(spark, odd):
    got = grouped(kmeans_tree.nearest(odd, F.col("vec_id") % 50 == 0, 5).collect())
    assert set(got) == {100, 150} and [v for v, _ in got[100]] == [4, 4, 5, 150] and got[100][0][1] == pytest.approx(1.0)
    assert kmeans_tree.nearest(odd.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    same = table(spark, [(i, [0.5, 0.25]) for i in range(500)])
    assert [v for v, _ in grouped(kmeans_tree.nearest(same, F.col("vec_id") == 3, 5).collect())[3]] == [0, 1, 2, 4, 5]


def test_best_bins_open_in_order():
    rng = np.random.default_rng(3)
    x = kmeans_tree.unit(rng.normal(size=(2000, 8)))
    tree = kmeans_tree.build_tree(x)
    assert sorted(kmeans_tree.best_bins(tree, x[0], tree["leaves"])) == list(range(tree["leaves"]))
    sizes = dict(enumerate(np.bincount(kmeans_tree.leaves_of(tree, x)).tolist()))
    assert sum(sizes[b] for b in kmeans_tree.best_bins(tree, x[0], 1, sizes, 300)) >= 300
    assert (np.bincount(kmeans_tree.leaves_of(tree, x)) <= kmeans_tree.LEAF_ROWS).all()
