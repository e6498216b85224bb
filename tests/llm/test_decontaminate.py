import random
import re

import pytest

from graniteseek.llm.decontaminate import WindowIndex, contamination, contamination_spans, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for item, body in items:
            w = WORD.findall(lower(body or ""))
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[k : k + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        out.append((doc, len(words), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_nodes", [4 << 20, 240])
def test_matches_brute_force(spark, docs_of, block_nodes):
    rng = random.Random(2)
    vocabulary = ["Ab", "c9", "é", "Ünd", "x", "yy", "Zed"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 10, 12, 14])))) for k in range(12)] + [(99, None), (98, "--- !"), (0, "x x x x x x")]
    docs = []
    for k in range(60):
        text = rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))
        if k % 3 == 0:
            text += " " + (rng.choice(items)[1] or "") + "; end"
        docs.append((k, text))
    docs += [(60, None), (61, ""), (0, docs[0][1])]
    frame = docs_of([t for _, t in docs], ids=[i for i, _ in docs], clashing=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in contamination(frame, bench, block_nodes=block_nodes).collect()), key=repr)
    assert got == brute(docs, items)
    clean = drop_contaminated(frame, bench, block_nodes=block_nodes)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((d, t or "") for (d, t), b in zip(docs, [x for x in [brute([d], items)[0] for d in docs]]) if not b[5])


def test_spans_point_into_the_original(spark, docs_of):
    item = "One two three four five six seven eight nine TEN"
    text = "Äh…  so: ONE, two; three\nfour five six seven eight nine ten! After"
    frame = docs_of([text, "nothing"])
    row, = contamination_spans(frame, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert (row.doc_id, row.item_id, row.passage) == (0, "5", "ONE, two; three\nfour five six seven eight nine ten") and text[row.start : row.stop] == row.passage


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(["a b", None])
    assert [r.contaminated for r in contamination(docs, none).collect()] == [False, False]
    assert contamination(docs.limit(0), none).count() == 0 and drop_contaminated(docs, none).count() == 2


def test_a_very_long_text(spark, docs_of):
    item = " ".join(f"w{k}" for k in range(10))
    row = contamination(docs_of(["q " * 300000 + item]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.n_words, row.n_hit, row.n_items) == (300010, 10, 1)


def test_clashing_names_and_copies_over_several_blocks(spark, docs_of):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(25))) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"a {items[k % 6][1]} b" for k in range(30)] + ["clean words", None, ""]
    docs = docs_of(texts, clashing=True)
    whole, parts = (sorted((r.doc_id, r.n_hit, r.items) for r in contamination(docs, bench, block_nodes=n).collect()) for n in (4 << 20, 260))
    assert whole == parts and [r[1] for r in whole] == [25] * 30 + [0] * 3
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, block_nodes=260).collect()) == [30, 31, 32]
    spans = contamination_spans(docs, bench, block_nodes=260).collect()
    assert {r.passage for r in spans if r.doc_id == 2} == {items[2][1]}


def test_memory_of_a_block_is_bounded():
    items = [(str(k), " ".join(f"w{k * 7 + j}" for j in range(40)).encode()) for k in range(300)]
    index = WindowIndex(items, 10)
    assert index.automaton.get_stats()["nodes_count"] <= 300 * 40 * 10 * 2
