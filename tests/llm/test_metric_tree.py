"""Top inner products in M-trees against brute force, what they leave out, and odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import metric_tree as mt

LONG = (1 << 63) - 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain(rows, is_query, k, scale=1024):
    whole = lambda v: [int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale) for c in v]
    rows = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in sorted({i for i, _ in rows if is_query(i)}):
        best = {}
        for own, a in rows:
            for i, b in rows if own == q else ():
                if i != q:
                    s = max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a, b, strict=False))))
                    best[i] = max(best.get(i, -LONG - 1), s)
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def found(df, is_query, **options):
    return sorted(tuple(r) for r in mt.top_products(df, is_query, **options).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block,fan,sample", [(4096, 64, 4096), (40, 3, 60)])
def test_top_products_against_brute_force(spark, block, fan, sample):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 12))
    v = np.concatenate((centres[rng.integers(6, size=260)] + 0.05 * rng.normal(size=(260, 12)), rng.normal(size=(80, 12)) * 5, np.repeat(rng.normal(size=(1, 12)), 90, 0)))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[8].tolist()), (7, v[7].tolist()), (20, v[300].tolist())]
    assert found(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, block=block, fan=fan, sample=sample) == plain(rows, lambda i: i % 10 == 0, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 0.0]), (5, [None, 1.0]), (6, []), (7, [0.0, -0.0003]), (8, [0.0, 0.0]), (9, [2.0, 1.0, 3.0]), (10, [2.0, 1.0])]
    df = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("q", F.lit("clash"))
    assert found(df, F.col("vec_id").isin(0, 6)) == plain(rows, lambda i: i in (0, 6), 10)
    assert found(df.limit(0), F.col("vec_id") == 0) == []
    assert found(df.where("vec_id = 8"), F.col("vec_id") == 8) == []


def test_large_components_and_scores_beyond_a_long(spark):
    rows = [(2**53, [3.0, 1e300]), (2**53 + 1, [3.0, -1e300]), (1, [1e12, 2.0]), (2, [1e-300, 1.0]), (3, [1e308, 1e308]), (4, [0.1, 7.0]), (5, [123456789.123, 1.0])]
    assert found(frame(spark, rows), F.lit(True), k=6) == plain(rows, lambda i: True, 6)


@pytest.mark.parametrize("size", [1, 5, 64, 65, 700])
def test_trees_cover_their_rows(size):
    rng = np.random.default_rng(size)
    v = np.concatenate((rng.normal(size=(size, 6)), np.zeros((size // 2, 6))))
    space = mt.Space(6, 14, 1.0)
    u = space.measured(v)
    space = mt.Space(6, 14, float(np.einsum("ij,ij->i", u, u).max()))
    rows = space.lifted(u)
    tree = mt.Tree.loaded(mt.Tree.built(rows, space.length2, page=8).dumped())
    assert sorted(tree.order.tolist()) == list(range(len(v)))
    rows = rows[tree.order]

    def below(node):
        a, b = tree.begin[node], tree.end[node]
        return list(range(a, b)) if tree.leaf[node] else [r for e in range(a, b) for r in below(tree.child[e])]

    assert sorted(below(0)) == list(range(len(v)))
    for node in np.flatnonzero(~tree.leaf):
        assert tree.end[node] - tree.begin[node] <= 8
        for e in range(tree.begin[node], tree.end[node]):
            away = np.sqrt(np.maximum(((rows[below(tree.child[e])] - rows[tree.object[e]]) ** 2).sum(1), 0))
            assert away.max() <= tree.radius[e] + 1e-6
            child = tree.child[e]
            if tree.leaf[child]:
                np.testing.assert_allclose(tree.row_parent[tree.begin[child] : tree.end[child]], away, atol=1e-6)
            else:
                inner = slice(tree.begin[child], tree.end[child])
                np.testing.assert_allclose(tree.parent[inner], np.sqrt(((rows[tree.object[inner]] - rows[tree.object[e]]) ** 2).sum(1)), atol=1e-6)


def test_bounds_leave_out_most_rows_of_clusters():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 16))[rng.integers(40, size=4000)] + 0.01 * rng.normal(size=(4000, 16))
    space = mt.Space(16, 14, 1.0)
    u = space.measured(v)
    space = mt.Space(16, 14, float(np.einsum("ij,ij->i", u, u).max()))
    tree = mt.Tree.built(space.lifted(u), space.length2)
    here = mt.Block(space, np.arange(4000)[tree.order], v[tree.order], tree)
    whole = np.floor(v * 1024).astype(np.int64)
    for i in range(0, 4000, 100):
        scores, ids = here.search(i, v[i], 10)
        exact = whole @ whole[i]
        want = sorted((j for j in range(4000) if j != i), key=lambda j: (-exact[j], j))[:10]
        assert ids.tolist() == want and scores.tolist() == exact[want].tolist()
    assert here.compared < 40 * 4000 / 3


def test_vectors_are_filled_up():
    assert mt.padded(pa.chunked_array([[[1.0], []], [[2.0, 3.0]]], pa.list_(pa.float64())), 2).tolist() == [[1, 0], [0, 0], [2, 3]]
