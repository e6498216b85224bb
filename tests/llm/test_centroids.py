import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteseek.llm.centroids import cluster_vectors

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, clusters=8, rounds=10, seed="3"):
    """The definition, on Python integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:clusters]
    centres = [list(x) for _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for k, xs in groups.items():
            centres[k] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [(i, *near(x)) for i, x in kept]
    total, by = sum(d for _, d, _ in found), {}
    for _, d, k in found:
        by[k] = by.get(k, 0) + d
    return sorted(((i, k, d, by[k], total, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, d, k in found), key=str)


def got(frame):
    return sorted((tuple(r)[:6] for r in frame.collect()), key=str)


def test_equals_the_definition_on_clustered_and_random_vectors(spark):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((6, 64))
    rows = [(k, (middles[k % 6] + 0.2 * rng.standard_normal(64)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(1000 + k, rng.standard_normal(64).astype(np.float32).tolist()) for k in range(100)]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    assert got(cluster_vectors(frame)) == brute(rows)


def test_screening_spares_exact_distances(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # random directions: the worst case
    frame = spark.createDataFrame([(k, v, None) for k, v in enumerate(x.tolist())], VECTORS)
    assert cluster_vectors(frame).agg(F.avg("n_exact")).first()[0] < 3


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [rng.standard_normal(64).tolist() for _ in range(5)]
    rows = [(1, good[0]), (1, good[0]), (2, good[1]), (None, good[2]), (3, None), (4, [1.0] * 63), (5, [float("nan")] * 64), (6, [float("inf")] + [0.0] * 63), (7, [None] + [0.0] * 63), (8, [0.0] * 64), (9, [-0.0] * 64), (10, good[3])]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS).withColumns({c: F.lit(7) for c in ("x", "id", "cluster", "code", "distance", "tried", "n", "sums")})
    assert got(cluster_vectors(frame)) == brute(rows)
    assert cluster_vectors(frame.limit(0)).count() == 0 and cluster_vectors(frame.filter("vec_id > 2 and vec_id < 8")).count() == 0
    alone = cluster_vectors(frame.filter("vec_id is null")).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in alone] == [(None, 0, 0, 0)]
    huge = spark.createDataFrame([(1, [3e38] * 64, None), (2, [-3e38] * 64, None), (3, [0.0] * 64, None)], VECTORS)
    assert sorted(r.distance for r in cluster_vectors(huge, clusters=1).collect())[0] >= 0


def test_ties_fall_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(12)]  # two distinct vectors, eight centroids
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    assert got(cluster_vectors(frame)) == brute(rows)
