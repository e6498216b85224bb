import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteseek.operators.ranking import cosine_top
from graniteseek.operators.vector_index import VectorOptions, build_vector_index, kmeans, search_vectors, train

VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType()))])


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v) for k, v in enumerate(np.asarray(x, np.float32).tolist())], VECTORS)


def brute(x, queries, k):
    x, u = (np.asarray(a, np.float32).astype(float) for a in (x, queries))
    c = np.round((u / np.linalg.norm(u, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 9)
    return {q: [int(j) for j in np.lexsort((np.arange(len(x)), -row))[:k]] for q, row in enumerate(c)}


def by_query(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append(r.id)
    return out


@pytest.mark.parametrize("clusters", [0, 25])
def test_recall_against_exact_search(spark, clusters):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32))
    if clusters:
        x = 0.25 * x + rng.standard_normal((clusters, 32))[rng.integers(0, clusters, 1500)]
    vectors, asked = frame(spark, x), frame(spark, x[::50]).withColumnRenamed("id", "q")
    index = build_vector_index(vectors, "id", "v")
    want = brute(x, x[::50], 10)
    found = search_vectors(index, asked, "q", "v", 10)
    got = by_query(found)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * 10 * len(want)
    assert all(len(g) == 10 for g in got.values())
    if clusters:
        assert index.probes <= len(index.codec.centres) // 2  # most lists are not read
    # all lists and candidates give the exact answer
    whole = search_vectors(index, asked, "q", "v", 10, probes=10**6, candidates=1500)
    assert by_query(whole) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exact_search_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((40, 8)), 30, axis=0)  # thirty copies of each
    got = cosine_top(frame(spark, x).repartition(3), frame(spark, x[::100]).withColumnRenamed("id", "q"), "id", "v", "q", "v", 7)
    assert by_query(got) == brute(x, x[::100], 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [2.0, 0.0]), (8, [1.0]), (None, [0.0, 1.0]), (1, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0])], VECTORS).withColumnRenamed("id", "q")
    index = build_vector_index(vectors, "id", "v")
    got = search_vectors(index, asked, "q", "v", 3, probes=10, candidates=10).collect()
    assert [(r.q, r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1), (0, 7), (0, 1)]
    exact = {q: [(r.id, round(r.dense_score, 6)) for r in sorted(cosine_top(vectors, asked, "id", "v", "q", "v", 3).filter(F.col("q") == q).collect(), key=lambda r: r["rank"])] for q in (0, 1, 3)}
    assert exact == {0: [(1, 1.0), (7, 1.0), (1, 0.707107)], 1: [(None, 0.0), (1, 0.0), (1, 0.0)], 3: [(8, 1.0), (None, 0.0), (1, 0.0)]}
    assert build_vector_index(vectors.filter("id in (2, 3, 4)"), "id", "v") is None
    assert search_vectors(index, asked.limit(0), "q", "v", 3).count() == 0


def test_codes_estimate_inner_products():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codec = train(x, 20, VectorOptions())
    lists, codes = codec.encode(x)
    q = x[:50]
    estimate = codec.estimates(q, codec.tables(q), lists, codes)
    assert codes.dtype == np.uint8 and np.corrcoef(estimate.reshape(-1), (q @ x.T).reshape(-1))[0, 1] > 0.9
    # the same as decoding and multiplying
    decoded = codec.centres[lists] + np.hstack([book[codes[:, j]] for j, book in enumerate(codec.books)])
    assert np.allclose(estimate, q @ decoded.T)


def test_kmeans_leaves_no_centroid_empty():
    x = np.repeat(np.eye(3), [50, 3, 1], axis=0)
    assert len(np.unique(np.round(kmeans(x, 3, 12, np.random.default_rng(0)), 6), axis=0)) == 3
