import random

import numpy as np
import pytest

from graniteseek.llm.order_minhash import _mixed, _seeds, drop_near_duplicates, edit_distance_within, labelled_kmers, near_duplicates, order_minhash, similar, word_hashes
from graniteseek.llm.shared import words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_matches_the_full_table():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randint(0, rng.choice([2, 30])) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.randint(0, 30)] * rng.randint(0, 2)
        most = rng.randint(0, 14)
        want = distance(a, b)
        assert edit_distance_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (want if want <= most else None)


def test_labels_tell_repeats_apart_and_keys_follow_order():
    x = labelled_kmers(word_hashes([b"a"] * 9))
    assert len(set(x.tolist())) == 5
    one, two = (order_minhash(labelled_kmers(word_hashes(t.split())), _seeds(40)) for t in (b"a b c d e f g h i j k l m n", b"h i j k l m n a b c d e f g"))
    assert (one == order_minhash(labelled_kmers(word_hashes(b"a b c d e f g h i j k l m n".split())), _seeds(40))).all() and (one == two).mean() < 0.8


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        k = rng.randrange(len(out))
        out[k : k + rng.choice([0, 1, 1])] = [f"n{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
    return out


def classes(rows):
    return {r.doc_id: r.class_id for r in rows}


def test_finds_copies_and_leaves_the_rest(spark, docs_of):
    rng = random.Random(7)
    vocabulary = [f"v{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts, want = [], []
    for k in range(60):
        base = rng.choices(vocabulary, k=rng.randint(30, 300))
        if k % 2:
            base[10:10] = passage  # shared by texts that differ otherwise
        group = [base, base] + [edited(rng, base, 0.04) for _ in range(k % 4)]
        for g in group:
            texts.append(rng.choice([" ", ", "]).join(g))
            want.append(k)
    w = [word_hashes(words_of(t.encode())) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(w[i], w[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = classes(near_duplicates(docs_of(texts), block=16).collect())
    assert [got[k] for k in range(len(texts))] == [root(k) for k in range(len(texts))]


def test_a_large_group_of_near_copies_is_one_class(spark, docs_of):
    rng = random.Random(3)
    base = [f"v{k}" for k in range(120)]
    texts = [" ".join(edited(rng, base, 0.04)) for _ in range(300)] + [" ".join(base)] * 200
    rows = near_duplicates(docs_of(texts), block=64).collect()
    assert {r.class_id for r in rows} == {0} and sum(r.kept for r in rows) == 1


def test_odd_rows(spark, docs_of):
    texts = [None, None, "", "", "!!", "?", "One two", "one  TWO!", "one three", "x " * 100000 + "end", "x " * 100000 + "end", "same", "same"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12]
    docs = docs_of(texts, ids=ids, clashing=True)
    rows = near_duplicates(docs).collect()
    got = classes(rows)
    assert [got[i] for i in ids] == [1, 2, 3, 3, 5, 6, 7, 7, 9, 10, 10, 12, 12]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 7, 9, 10, 12]
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0
    nulls = docs_of(["a b c", "a b c", "d"], ids=[None, 4, None])
    assert sorted(str((r.doc_id, r.class_id)) for r in near_duplicates(nulls).collect()) == ["(4, 4)", "(None, 4)", "(None, None)"]


def substituted(rng, words, at):
    return [f"n{rng.randrange(10**9)}" if k in at else w for k, w in enumerate(words)]



def test_chains_of_versions_in_one_bucket(spark, docs_of):
    # both sketches pick one passage, and the first of the bucket is like only one end of the chain
    rng, found = random.Random(11), 0
    for _ in range(400):
        base = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        chain = [base]
        for k in range(2):
            chain.append(substituted(rng, chain[-1], range(50 + 15 * k, 65 + 15 * k)))
        keys = [order_minhash(labelled_kmers(word_hashes([w.encode() for w in c]), 5), _seeds(2)).tolist() for c in chain]
        if keys[0] == keys[1] == keys[2]:
            found += 1
            got = classes(near_duplicates(docs_of([" ".join(c) for c in chain]), sketches=2, size=5).collect())
            assert got == {0: 0, 1: 0, 2: 0}
            if found == 4:
                return
    raise AssertionError("no such chain")


def test_one_equal_sketch_is_enough(spark, docs_of):
    # one bucket of many components: a word that the only sketch picks stands in every text
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(4000)]
    seed = _seeds(1)
    picked = vocabulary[min(range(4000), key=lambda k: int(_mixed(labelled_kmers(word_hashes([vocabulary[k].encode()]), 1) ^ seed)[0]))]
    texts, want = [], []
    for k in range(40):
        base = [picked] + rng.choices(vocabulary, k=99)
        for version in (base, *(substituted(rng, base, rng.sample(range(1, 100), 12)) for _ in range(k % 2))):
            texts.append(" ".join(version))
            want.append(len(texts) - 1 if version is base else want[-1])
    for block in (2048, 8):
        got = classes(near_duplicates(docs_of(texts), sketches=1, picks=1, size=1, block=block).collect())
        assert [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_recall_at_the_threshold(spark, docs_of, similarity):
    rng = random.Random(13)
    texts = []
    for n in [10, 30, 64, 70, 100, 300] * 30:
        base = [f"v{k}" for k in rng.choices(range(3000), k=n)]
        texts += [" ".join(base), " ".join(substituted(rng, base, rng.sample(range(n), int((1 - similarity) * n + 1e-9))))]
    for k in range(20):  # ten words, the fifth changed
        base = [f"w{k}x{j}" for j in range(10)]
        texts += [" ".join(base), " ".join(substituted(rng, base, [4]))]
    got = classes(near_duplicates(docs_of(texts)).collect())
    found = sum(got[k] == got[k + 1] for k in range(0, len(texts), 2))
    assert found >= 0.99 * len(texts) / 2


def test_rows_of_one_id_are_told_apart_by_text(spark, docs_of):
    same, other = "one two three four five six", "quite another text that stands alone here"
    texts = [same, same, other, other, None, None, same, "null id text a b c d", "null id text a b c d"]
    ids = [1, 1, 1, 2, 1, 3, 4, None, None]
    docs = docs_of(texts, ids=ids)
    rows = near_duplicates(docs).collect()
    assert sum(r.kept for r in rows) == 5 and len(rows) == 9
    kept = sorted(((str(r.doc_id), str(r.text)) for r in drop_near_duplicates(docs).collect()))
    assert kept == sorted([("1", same), ("1", other), ("1", "None"), ("3", "None"), ("None", texts[-1])])


def test_bands_of_length_lose_no_pair():
    from graniteseek.llm.order_minhash import SIMILARITY
    import math

    width = -math.log(SIMILARITY) * 1.001
    for n in [*range(1, 3000), 10**6, 10**7 + 3]:
        for m in (n, math.ceil(n * SIMILARITY - 1e-9), max(1, math.ceil(n * SIMILARITY))):
            assert abs(math.floor(math.log(max(m, 1)) / width) - math.floor(math.log(n) / width)) <= 1


def test_word_hashes_do_not_depend_on_the_place():
    words = [b"a", b"b" * 5, b"a", b"x" * 255, b"x" * 256, b"x" * 257, "é".encode(), b"y" * 200_000] + [b"w%d" % k for k in range(30_000)] + [b"y" * 200_000, b"a"]
    got = word_hashes(words)
    assert len(got) == len(words) and len(set(got.tolist())) == len(set(words))
    assert all(int(word_hashes([words[k]])[0]) == int(got[k]) for k in [*range(40), -2, -1])
    assert not len(word_hashes([]))
