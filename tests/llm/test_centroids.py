"""K-means on whole numbers, against rounds over all vectors and centroids in plain Python."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from scriptorium.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int, n int"


def brute(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    middle = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else old for k, old in enumerate(middle)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    total = {}
    for _, k, d in found:
        total[k] = total.get(k, 0) + d
    return [(i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, middle[k])).encode()).hexdigest()) for i, k, d in found]


def same(spark, rows):
    df = spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    assert sorted(map(str, map(tuple, centroids.clustered(df).collect()))) == sorted(map(str, brute(rows)))


def test_tight_groups_and_one_hot_vector(spark):
    rng = random.Random(2)
    hot = [rng.gauss(0, 1) for _ in range(64)]
    spots = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(k, hot if k % 3 == 0 else [x + rng.gauss(0, 0.05) for x in spots[k % 6]]) for k in range(500)]
    same(spark, rows)


def test_bad_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [0.0] * 63), (4, [nan] + [0.0] * 63), (5, [inf] * 64), (6, [None] + [1.0] * 63), (7, [0.0] * 65)]
    ties = [(k, [float(k % 2)] + [0.0] * 62 + [-1e-9]) for k in range(20, 60)] + [(20, [3.0] * 64), (20, [3.0] * 64), (None, [0.5] * 64)]
    same(spark, bad + ties)
    same(spark, bad)
    same(spark, [(1, [2.0] * 64), (2, [100_000.5] * 64)])


def test_whole_small_table_and_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    got = sorted(map(tuple, centroids.clustered(spark.read.parquet(path)).collect()))
    assert got == sorted(brute([(r.vec_id, r.embedding) for r in spark.read.parquet(path).collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert got == sorted(con.execute(centroids.oracle_sql()).fetchall())


@pytest.mark.parametrize("scale", [30, 3_000_000])
def test_trees_assign_as_all_distances_do(scale):
    rng = np.random.default_rng(scale)
    points = (rng.normal(size=(3000, 5)) * scale).astype(np.int64)
    middle = points[:12].copy()
    middle[3] = middle[1]
    order, tree = centroids.Tree.built(points)
    n, sums, cluster, distance = tree.assign(middle, each=True)
    every = ((points[order][:, None] - middle) ** 2).sum(2)
    assert np.array_equal(cluster, every.argmin(1)) and np.array_equal(distance, every.min(1))
    assert np.array_equal(n, np.bincount(cluster, minlength=12)) and np.array_equal(sums[0], points[order][cluster == 0].sum(0))


def test_whole_nodes_are_assigned_without_distances():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(0, 50, (1000, 3)), rng.integers(5000, 5050, (1000, 3))])
    _, tree = centroids.Tree.built(points)
    candidates = tree._filtered(np.array([1, 2]), np.ones((2, 2), bool), np.array([[25, 25, 25], [5025, 5025, 5025]]))
    assert candidates.sum() == 2
