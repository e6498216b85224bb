import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteseek.functions.text import retrieval_tokens
from graniteseek.operators.pools import bm25_of_pool, hashed_vector, pool_scores, with_fit_blocks
from graniteseek.operators.ranking import bm25_scores

ROWS = T.StructType([T.StructField("pool", T.LongType()), T.StructField("key", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType()))])
ASKED = T.StructType([T.StructField("pool", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


def pools(rng):
    rows = [(p, k, rng.choices([f"w{j}" for j in range(30)], k=rng.choice([0, 1, 5, 30]))) for p in range(8) for k in range(rng.choice([1, 4, 12]))]
    return rows, [(p, rng.choices([f"w{j}" for j in range(40)], k=4)) for p in range(7)] + [(99, ["w1"])]


def test_pool_scores_equal_those_of_the_corpus_operator(spark):
    rows, asked = pools(random.Random(1))
    frame, queries = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED)
    got = {(r.pool, r.key): r for r in pool_scores(frame, queries, "pool").collect()}
    want = {(r.pool, r.key): r.bm25_score for r in bm25_scores(frame, queries, ["pool"], ["key"]).collect()}
    assert set(got) == set(want) == {(p, k) for p, k, _ in rows}
    assert all(got[k].bm25_score == pytest.approx(want[k], abs=1e-9) for k in want)
    by_pool = dict(asked)
    for p, k, tokens in rows:
        a, b = hashed_vector(tokens), hashed_vector(by_pool.get(p, []))
        assert got[p, k].vector == (None if a is None else pytest.approx(a.tolist()))
        assert got[p, k].dense_score == pytest.approx(0.0 if a is None or b is None else float(a @ b))


def test_a_pool_takes_one_shuffle_of_its_rows(spark):
    rows, asked = pools(random.Random(2))
    plan = pool_scores(spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED), "pool")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # rows, and queries


def test_blocks_of_a_text_take_none(spark):
    rng = random.Random(3)
    texts = ["\n\n".join(" ".join(rng.choices(["Zebra", "crossing", "the", "of", "a", "street", "É-x"], k=rng.randint(0, 12))) for _ in range(rng.randint(1, 9))) for _ in range(30)] + [None, "", "\n\n\n"]
    frame = spark.createDataFrame([(k, t, "zebra crossing") for k, t in enumerate(texts)], "id long, markdown string, query string").withColumn("asked_tokens", F.lit(7))
    out = with_fit_blocks(frame, retrieval_tokens(F.col("query")), 0.6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and out.columns == [*frame.columns, "fit"]
    got = {r.id: r.fit for r in out.collect()}
    # each text as a corpus of its own
    blocks = frame.filter("markdown is not null").select("id", F.posexplode(F.split("markdown", r"\n{2,}")).alias("pos", "block")).withColumn("tokens", retrieval_tokens(F.col("block")))
    asked = frame.select("id", retrieval_tokens(F.col("query")).alias("tokens"))
    want = {}
    for r in sorted(bm25_scores(blocks, asked, ["id"], ["pos"]).filter("bm25_score >= 0.6").collect(), key=lambda r: (r.id, r.pos)):
        want.setdefault(r.id, []).append(r.block)
    assert {k: v for k, v in got.items() if v is not None} == {k: "\n\n".join(v) for k, v in want.items()} and len(want) > 5


def test_scores_by_the_formula():
    documents = [["a", "b"], ["a"], [], ["c", "c", "a"]]
    got = bm25_of_pool(documents, ["c", "c", "x"])
    idf = math.log(4 - 1 + 0.5) - math.log(1.5)
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.5)))
    assert bm25_of_pool([], ["a"]) == [] and bm25_of_pool([[]], ["a"]) == [None]
