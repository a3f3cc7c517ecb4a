import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import neighbours
from mailsift.llm.registry import QUERIES

NAN, INF = float("nan"), float("inf")


def exact(rows, k=10, step=100):
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    for q in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((points - points[q])**2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        yield from ((int(ids[q]), r + 1, int(ids[i]), d[i]) for r, i in enumerate(order))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
            if r.embedding and any(r.embedding)]
    expected = {(q, v): s for q, _, v, s in exact(rows)}
    got = QUERIES["op7_multi_index"](spark, f"/root/testdata/{sf}").collect()
    found = {(r.query_id, r.vec_id): r.score for r in got}
    both = found.keys() & expected.keys()
    assert len(got) == len(found) == len(expected) and len(both) >= 0.9 * len(expected)
    assert all(abs(found[p] - expected[p]) < 1e-12 for p in both)
    for q in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)


def test_full_walk_is_exact_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 6) for i in range(200)]
    bad = [(2000, None), (2100, [0.0] * 6), (2200, [1.0, NAN] * 3), (2300, [1.0, INF] * 3), (2400, [1.0, None] * 3),
           (2500, [1.0, 2.0]), (2600, []), (None, [1.0] * 6), (100, rows[100][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, first int")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, centroids=8, probe=1.0).collect()
    expected = list(exact(rows))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(e[:3] for e in expected)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    order = sorted(((a[i] + b[j], i, j) for i in range(9) for j in range(7)))
    for wanted in (1, 5, 20, 63):
        masks = neighbours.walk(a, b, {(i, j): 1 for i in range(9) for j in range(7)}, wanted)
        assert {(i, j) for i, m in masks.items() for j in range(7) if m >> j & 1} == {(i, j) for _, i, j in order[:wanted]}
