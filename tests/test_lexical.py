import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteseek.operators.dedupe import lexical_survivors
from graniteseek.operators.lexical import first_independent, mark_lexical

ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("pool", T.StringType()), T.StructField("text", T.StringType())])


def families(rng, n):
    """Texts in families of near copies, some in chains where each is near the next only."""
    words = [f"w{k}" for k in range(300)]
    out = []
    while len(out) < n:
        base = rng.choices(words, k=rng.randint(1, 40))
        for _ in range(rng.choice([1, 1, 2, 8, 20])):
            out.append(" ".join(base))
            for _ in range(rng.randint(0, 3)):
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(words)
    rng.shuffle(out)
    return out[:n]


def kept(frame):
    return {r.id for r in frame.filter("kept").collect()}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.92])
def test_equals_the_greedy_walk(spark, threshold):
    texts = families(random.Random(int(threshold * 100)), 260)
    frame = spark.createDataFrame([(k, "p", t) for k, t in enumerate(texts)], ROWS).repartition(3)
    want = set(lexical_survivors(texts, threshold))
    assert len(want) < 230
    assert kept(mark_lexical(frame, "id", threshold)) == want
    # without frequent words put last, and with words of many texts dealt into blocks
    assert kept(mark_lexical(frame, "id", threshold, common=0, block=3)) == want


def test_pools_are_apart(spark):
    texts = families(random.Random(5), 120)
    frame = spark.createDataFrame([(k, "ab"[k % 2], t) for k, t in enumerate(texts)], ROWS)
    want = {k for p in (0, 1) for k in (2 * j + p for j in lexical_survivors(texts[p::2], 0.8))}
    assert kept(mark_lexical(frame, "id", 0.8, ["pool"])) == want


def test_thousands_of_near_copies_cost_a_comparison_each(spark):
    rng = random.Random(6)
    base = [f"c{k}" for k in range(60)]
    texts = [" ".join(base[:k % 60] + [f"own{k}"] + base[k % 60 + 1 :]) for k in range(1500)] + [" ".join(rng.choices([f"x{k}" for k in range(500)], k=30)) for _ in range(200)]
    frame = spark.createDataFrame([(k, "p", t) for k, t in enumerate(texts)], ROWS)
    assert kept(mark_lexical(frame, "id", 0.8)) == set(lexical_survivors(texts, 0.8))


def test_odd_rows(spark):
    texts = [None, "", "  ", "!!", "!!", "?", "a b", "B A", "a b c", None, "é", "é "]
    frame = spark.createDataFrame([(k, "p", t) for k, t in enumerate(texts)], ROWS).withColumns({c: F.lit(7) for c in ("row", "cls", "words", "size", "place", "hi", "at", "n")})
    out = mark_lexical(frame, "id", 0.6)
    assert kept(out) == set(lexical_survivors(texts, 0.6)) and out.columns == [*frame.columns, "kept"]
    assert kept(mark_lexical(frame, "id", 1.0)) == set(range(len(texts)))
    assert kept(mark_lexical(frame, "id", 0.0)) == set(lexical_survivors(texts, 0.0))
    assert mark_lexical(frame.limit(0), "id", 0.8).count() == 0
    same = spark.createDataFrame([(None, "p", "a b"), (None, "p", "a b"), (1, "p", "a b")], ROWS)
    assert mark_lexical(same, "id", 0.8).filter("kept").count() == 1


def test_sketches_leave_few_pairs_and_lose_none(spark):
    from graniteseek.operators.lexical import _ordered

    rng = random.Random(8)
    base = [rng.sample(range(10**6), 60) for _ in range(40)]
    sets = base + [b[:55] + rng.sample(range(10**6), 5) for b in base]
    got = {r.row: r for r in _ordered(spark.createDataFrame(list(enumerate(sets)), "row long, words array<long>"), 0.8, 100).collect()}
    assert all(len(r.prefix) == 60 - 48 + 1 and r.size == 60 and len(r.sketch) == 8 for r in got.values())
    apart = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(got[x].sketch, got[y].sketch))
    assert all(apart(x, y) <= len(set(sets[x]) ^ set(sets[y])) for x in range(80) for y in range(80))
    assert sum(apart(x, y) * 1.8 <= 0.2 * 120 for x in range(80) for y in range(x)) == 40


def test_pairs_of_large_sets_go_where_they_are_made(spark):
    from graniteseek.operators.lexical import _candidates, _ordered, _prefixes

    rng = random.Random(9)
    base = [rng.sample(range(20_000), n) for n in (50, 400, 1100, 2000) for _ in range(8)]
    sets = base + [b[: len(b) - len(b) // 20] + rng.sample(range(10**6, 2 * 10**6), len(b) // 20) for b in base]
    left = _ordered(spark.createDataFrame(list(enumerate(sets)), "row long, words array<long>"), 0.8, 100).withColumnRenamed("row", "cls").cache()
    x, y = (_prefixes(left).select("word", F.col("cls").alias(side)) for side in "ab")
    assert x.join(y, "word").filter("a < b").select("a", "b").distinct().count() > 200
    near = {(k, k + 32) for k in range(32)}
    for block in (1000, 2):  # words of more texts are dealt into blocks
        assert {(r.a, r.b) for r in _candidates(left, 0.8, block).collect()} == near


def test_sketches_of_unlike_lengths_lose_no_pair(spark):
    rng = random.Random(10)
    sets = [rng.sample(range(10**6), n) for n in (100, 600, 690, 1360, 1500, 3000)]
    sets += [s[: len(s) // 2 + 1] for s in sets]
    texts = [" ".join(f"w{w}" for w in s) for s in sets]
    frame = spark.createDataFrame([(k, "p", t) for k, t in enumerate(texts)], ROWS)
    for threshold in (0.2, 0.5, 0.8):
        assert kept(mark_lexical(frame, "id", threshold)) == set(lexical_survivors(texts, threshold))


def test_first_independent_set_by_rounds(spark):
    rng = random.Random(7)
    links = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(150)} | {(k, k + 1) for k in range(80, 110)})
    stays = set()
    for node in range(111):
        if not any((a, node) in links and a in stays for a in range(node)):
            stays.add(node)
    gone = {r.node for r in first_independent(spark.createDataFrame(links, "a long, b long")).collect()}
    assert gone == set(range(111)) - stays
