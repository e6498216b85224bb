import math

import numpy as np
import pytest
from pyspark.sql import types as T

from graniteseek.llm.components import connected_components
from graniteseek.llm.embedding_dedup import drop_near_vectors, embedding_components

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, cosine=0.93):
    able = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {k: np.array(rows[k][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[k][1], np.float32).astype(float)) for k in able}
    for i in able:
        for j in able:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, (v, _, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), v), v)
    return sorted((v, links[k], least[root(k)], v == least[root(k)]) for k, (v, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 16])
def test_links_and_components_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for k in range(300):
        v = centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.05, 0.25, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3)) if k % 17 else None))
    rows += [(300 + k, rows[5][1], 1) for k in range(40)] + [(400, [2 * x for x in rows[7][1]], rows[7][2])]
    frame = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in embedding_components(frame, cell=24, block=block).collect())
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 1.0], None), (8, [1.0, 1.0], 1), (9, [1.0, 1.0], 1), (10, [1.0, 1.0, 1.0], 1), (11, [1e30, 1e30], 1), (12, [1e-30, 1e-30], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_components(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all(got[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 7, 10))
    assert got[8] == (3, 8, True) and all(got[k] == (3, 8, False) for k in (9, 11, 12))
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_components(empty).count() == 0
    assert sorted(r.vec_id for r in drop_near_vectors(spark.createDataFrame(rows, VECTORS)).collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 10]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {}
    for r in found:
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, roots.values())) == [list(range(7, 60)), list(range(100, 161))]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("cell", "block"), [(40, 2048), (40, 16), (200, 64)])
def test_cells_are_split_and_lose_no_link(spark, cell, block, monkeypatch):
    from graniteseek.llm import embedding_dedup

    split = []
    real = embedding_dedup._split
    monkeypatch.setattr(embedding_dedup, "_split", lambda points, centres, radius: split.append(len(centres)) or real(points, centres, radius))
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    rows = [(k, [float(np.float32(x)) for x in centres[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.03, 0.12, 0.2])], int(k % 2)) for k in range(900)]
    got = sorted(tuple(r) for r in embedding_components(spark.createDataFrame(rows, VECTORS), cell=cell, block=block).collect())
    assert got == brute(rows) and len(split) >= 1 and sum(split) >= 2


def test_a_dense_ball_is_not_replicated(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(np.float32(x)) for x in 1 + rng.normal(size=6) * 0.02], 1) for k in range(300)]
    got = sorted(tuple(r) for r in embedding_components(spark.createDataFrame(rows, VECTORS), cell=30, block=64).collect())
    assert got == brute(rows)


def test_clashing_names_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (None, None, None)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(5) for c in ("id", "cls", "hi", "kept_id", "v", "cell", "home", "n")})
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_components(frame).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 1, "2"), ("2", 1, "2"), ("None", 0, "None"), ("None", 2, "1")]
    kept = drop_near_vectors(frame)
    assert kept.columns == frame.columns and {r.vec_id for r in kept.collect()} == {1, 2, None}


def compared(spark, x, cell=32):
    """Pairs that cells compare, as a share of all, and whether vectors were dealt to parts at all."""
    from pyspark.sql import functions as F

    from graniteseek.llm.embedding_dedup import partition

    rows = [(k, [float(v) for v in row], 1) for k, row in enumerate(np.asarray(x, np.float32))]
    classes = spark.createDataFrame(rows, "cls long, v array<float>, label int").withColumn("n", F.lit(1).cast("long"))
    points = partition(classes, math.sqrt(2 - 2 * 0.93), cell)
    cells = points.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("size")).agg(F.sum(F.col("homes") * F.col("size")).alias("pairs"), F.sum("homes").alias("homes"), F.sum("size").alias("places"), F.count("*").alias("cells")).first()
    assert cells.homes == len(x)
    return cells.pairs / len(x) ** 2, cells.places / len(x), cells.cells


@pytest.mark.parametrize(("clusters", "n"), [(30, 1500), (300, 6000), (3000, 18000)])
def test_the_triangle_inequality_spares_most_pairs_of_clustered_vectors(spark, clusters, n):
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((clusters, 64))[rng.integers(0, clusters, n)] + 0.12 * rng.standard_normal((n, 64))
    share, places, cells = compared(spark, x)
    assert share < 0.2 and places < 4 and cells >= clusters / 4


def test_pairs_grow_in_proportion_with_clusters(spark):
    rng = np.random.default_rng(77)
    pairs = []
    for n in (1200, 6000):
        x = rng.standard_normal((n // 20, 64))[rng.integers(0, n // 20, n)] + 0.12 * rng.standard_normal((n, 64))
        pairs.append(compared(spark, x)[0] * n * n)
    assert math.log(pairs[1] / pairs[0]) / math.log(5) < 1.1


def test_pivots_take_part_on_the_given_tables(spark, monkeypatch):
    from graniteseek.llm import embedding_dedup
    from graniteseek.llm.queries import op2_embedding_dedup

    used = []
    real = embedding_dedup._split
    monkeypatch.setattr(embedding_dedup, "_split", lambda points, centres, radius: used.extend(len(p) for p in centres.values()) or real(points, centres, radius))
    rows = [(k, v.tolist(), int(lab)) for k, (v, lab) in enumerate(zip(np.random.default_rng(5).standard_normal((500, 64)).astype(np.float32), np.random.default_rng(6).integers(0, 10, 500)))]
    frame = spark.createDataFrame(rows, VECTORS)  # as the given tables: random directions, some fifty a label
    assert embedding_components(frame).filter("kept").count() == 500
    assert len(used) >= 5 and callable(op2_embedding_dedup)
