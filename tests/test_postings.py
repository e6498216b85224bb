import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteseek.operators.postings import Shard, build_index, index_statistics, shard_rows, stored_index, _schema
from graniteseek.operators.ranking import bm25_shards, bm25_top, term_statistics

CORPUS = T.StructType([T.StructField("id", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType()))])
ASKED = T.StructType([T.StructField("q", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


def texts(rng, n):
    """Documents of very different lengths over words of very different frequencies."""
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    return [rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 60, 400])) for _ in range(n)]


def brute(corpus, queries, k):
    """All scores by the formula, best first, ties by position."""
    n, mean = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = Counter(t for d in corpus for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    average = sum(raw.values()) / len(raw)
    out = {}
    for q, asked in enumerate(queries):
        scored = []
        for pos, d in enumerate(corpus):
            tf = Counter(d)
            s = sum((0.25 * average if raw[t] < 0 else raw[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in asked if t in tf)
            scored.append((-round(s, 9), pos))
        out[q] = [(p, -s) for s, p in sorted(scored)[:k]]
    return out


def frames(spark, corpus, queries, partitions=3):
    rows = [(f"d{p}", p, t) for p, t in enumerate(corpus)]
    return spark.createDataFrame(rows, CORPUS).repartition(partitions), spark.createDataFrame(list(enumerate(queries)), ASKED)


@pytest.mark.parametrize(("documents", "tokens"), [(16_384, 1 << 22), (256, 5_000)])
def test_pruned_search_equals_scoring_all(spark, documents, tokens):
    rng = random.Random(11)
    corpus = texts(rng, 900)
    queries = [rng.choices([f"w{k}" for k in range(420)], k=rng.randint(1, 12)) for _ in range(25)]
    queries += [["w0"], ["w0", "w1", "w2"], ["absent"], [], ["w399"], ["w0"] * 5 + ["w300"], corpus[5]]
    docs, asked = frames(spark, corpus, queries)
    index = stored_index(docs, "id", "pos", documents=documents, most_tokens=tokens)
    assert (index.filter("term IS NULL").count() > 3) == (documents == 256)
    got = {}
    for r in bm25_top(docs, asked, "id", "pos", "q", 10, index=index).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.pos, r.bm25_score, r.id)
    for q, want in brute(corpus, queries, 10).items():
        found = [got[q][k] for k in sorted(got[q])]
        assert [p for p, _, _ in found] == [p for p, _ in want], q
        assert np.allclose([s for _, s, _ in found], [s for _, s in want], atol=1e-8) and all(i == f"d{p}" for p, _, i in found)


def test_few_documents_are_scored(spark):
    rng = random.Random(12)
    corpus = [d + ["needle"] * (k % 97 == 0) for k, d in enumerate(texts(rng, 3000))]
    docs, asked = frames(spark, corpus, [["w0", "w1", "w2", "w40", "needle"], ["w3", "w70", "w90"]], 2)
    count = bm25_shards(stored_index(docs, "id", "pos"), asked, "q", 10).filter("best_pos IS NULL").agg(F.sum("pairs"), F.sum("scored")).first()
    assert count[0] == 6000 and 0 < count[1] < 0.2 * count[0]


def test_statistics_come_from_the_index(spark):
    corpus = texts(random.Random(13), 200)
    docs, _ = frames(spark, corpus, [[]])
    a, b = (sorted(map(tuple, f.select("term", "df", "length").collect()), key=str) for f in (index_statistics(build_index(docs, "id", "pos")), term_statistics(docs)))
    assert a == b


def test_a_shard_reads_back_as_it_was(spark):
    rng = random.Random(14)
    corpus = texts(rng, 300)
    schema = _schema(T.StringType())
    batch = shard_rows(pa.array(corpus, pa.list_(pa.string())), np.arange(300), pa.array([f"d{k}" for k in range(300)]), 7, schema)
    terms = pa.array(sorted({t for d in corpus for t in d}))
    shard = Shard.of(pa.Table.from_batches([batch]), terms)
    for j, t in enumerate(terms.to_pylist()):
        b = shard.blocks[j]
        p = slice(shard.begin[b.start], shard.end[b.stop - 1])
        got = {int(shard.positions[d]): int(f) for d, f in zip(shard.document[p], shard.tf[p])}
        assert got == {k: d.count(t) for k, d in enumerate(corpus) if t in d}
        assert (np.diff(shard.document[p]) > 0).all()
    assert (np.diff(shard.lengths) >= 0).all()


def test_odd_corpora(spark):
    docs, asked = frames(spark, [], [["a"], []])
    assert bm25_top(docs, asked, "id", "pos", "q", 5).count() == 0
    docs, asked = frames(spark, [[], ["a"], ["a"]], [["a"], [], ["b"]])
    docs = docs.unionByName(spark.createDataFrame([(None, 3, None), ("d1", 4, ["a"])], CORPUS))
    rows = bm25_top(docs, asked, "id", "pos", "q", 3).orderBy("q", "rank").collect()
    assert [r.pos for r in rows if r.q == 1] == [0, 1, 2] and [r.pos for r in rows if r.q == 2] == [0, 1, 2]
    assert len(rows) == 9
    none = bm25_top(docs, asked.limit(0), "id", "pos", "q", 3)
    assert none.count() == 0
