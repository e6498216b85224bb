import random

import pytest

from graniteseek.llm.mixing import _Draws, flight, landing, mix_sources, take_mix, targets_of


def test_targets_share_the_excess_until_none_is_above():
    got = targets_of({"a": 100, "b": 10, None: 1000})
    assert sum(got.values()) == pytest.approx(1110) and got["b"] == 30
    assert got["a"] == pytest.approx(1080 / 4) and got[None] == pytest.approx(1080 * 3 / 4)
    assert all(got[s] <= 3 * n + 1e-9 for s, n in {"a": 100, "b": 10, None: 1000}.items())
    assert targets_of({}) == {} and targets_of({"x": 0}) == {"x": 0.0}


@pytest.mark.parametrize("seed", range(20))
def test_flight_keeps_both_totals(seed):
    rng = random.Random(seed)
    sizes = [float(rng.choice([1, 5, 5, 300, rng.randint(1, 9000)])) for _ in range(rng.randint(0, 120))]
    chances = [rng.choice([0.0, 1.0, rng.random(), 0.4]) for _ in sizes]
    out = flight(sizes, chances, _Draws(seed))
    assert sum(0 < c < 1 for c in out) <= 2
    assert sum(out) == pytest.approx(sum(chances), abs=1e-6)
    assert sum(s * c for s, c in zip(sizes, out)) == pytest.approx(sum(s * c for s, c in zip(sizes, chances)), rel=1e-6, abs=1e-4)
    landed = landing(sizes, out)
    assert all(c in (0.0, 1.0) for c in landed) and abs(sum(landed) - sum(chances)) < 1 + 1e-6


def test_chances_are_kept_on_average():
    sizes, chance = [3.0, 8.0, 8.0, 20.0, 31.0, 45.0, 60.0, 70.0], [0.3] * 8
    n = 3000
    taken = [0.0] * 8
    for k in range(n):
        for j, c in enumerate(flight(sizes, chance, _Draws("mean", k))):
            taken[j] += c / n
    assert taken == pytest.approx(chance, abs=0.04)


def test_mix_comes_near_its_targets_and_repeats(spark, docs_of):
    rng = random.Random(5)
    sources = [rng.choice(["hot", "hot", "hot", "b", "c", None]) for _ in range(900)]
    texts = ["w " * rng.randint(1, 60) for _ in sources]
    docs = docs_of(texts, sources=sources).repartition(3)
    rows = mix_sources(docs, block_rows=32).collect()
    again = mix_sources(docs.repartition(7, "text"), block_rows=32).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert len(rows) == 900 and all(r.taken <= 3 * r.size for r in rows)
    for s in set(sources):
        mine = [r for r in rows if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=60)


def test_odd_rows(spark, docs_of):
    docs = docs_of([None, "", "a b", "a b", "x " * 50000, "é b"], ids=[1, 2, 3, 3, None, 5], sources=["s", None, "s", "s", "t", "t"], clashing=True)
    rows = mix_sources(docs).collect()
    assert sorted(r.size for r in rows) == [0, 0, 1, 2, 2, 50000]
    assert all(r.taken == 0 for r in rows if not r.size)
    assert mix_sources(docs.limit(0)).count() == 0


def test_the_mix_itself(spark, docs_of):
    docs = docs_of(["a b c", "d", "d", "e f"] * 30, ids=[k % 60 for k in range(120)], sources=["s", "t", "t", "u"] * 30, clashing=True)
    decided = {}
    for r in mix_sources(docs).collect():
        decided[(r.doc_id, r.source)] = decided.get((r.doc_id, r.source), 0) + r.copies
    got = {}
    mixed = take_mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in decided.items() if n}
    assert take_mix(docs.limit(0)).count() == 0


def test_ids_are_carried_as_they_are(spark, docs_of):
    ids = [None] + [(1 << 62) + k for k in range(9)]
    docs = docs_of([f"w{k} " * (k + 3) for k in range(10)], ids=ids, sources=["s"] * 5 + ["t"] * 5)
    assert sorted(str(r.doc_id) for r in mix_sources(docs).collect()) == sorted(map(str, ids))


def test_names_of_the_join_may_stand_in_the_table(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of(["a b c", "d e"] * 20).withColumns({c: F.lit(1) for c in ("m_id", "m_source", "M_TAG", "times", "place")})
    assert take_mix(docs).columns == docs.columns and take_mix(docs).count() == sum(r.copies for r in mix_sources(docs).collect())


def test_equal_rows_are_one_unit(spark, docs_of):
    docs = docs_of(["the same words"] * 3000 + [f"w{k} other" for k in range(500)], ids=[7] * 3000 + list(range(100, 600)), sources=["s"] * 3300 + ["t"] * 200)
    rows = mix_sources(docs, block_rows=32).collect()
    mine = [r.copies for r in rows if r.doc_id == 7]
    assert len(rows) == 3500 and len(mine) == 3000 and max(mine) - min(mine) <= 1
    for s in "st":
        some = [r for r in rows if r.source == s]
        assert sum(r.taken for r in some) == pytest.approx(some[0].target, abs=10) and all(r.taken <= 3 * r.size for r in some)
    assert sum(r.doc_id == 7 for r in take_mix(docs, block_rows=32).collect()) == sum(mine)


def test_too_many_sources_are_refused(spark, docs_of):
    with pytest.raises(ValueError, match="sources"):
        mix_sources(docs_of(["a"] * 5, sources=list("abcde")), most_sources=4)
