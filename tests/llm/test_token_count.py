import random

import pytest
from pyspark.sql import functions as F

from graniteseek.llm.token_count import EDITS, TokenTree, build_trees, leaves_of, recount, scrub_edits
from graniteseek.llm.tokenizer import encoding, read_vocabulary


@pytest.fixture(scope="module")
def count():
    coder = encoding(read_vocabulary())
    return lambda s: len(coder.encode_ordinary(s))


def some_text(rng, n):
    return "".join(rng.choices(["word", " ", "\n", "'s", "é", "12", ", ", "The", "日", "  ", "x" * 9, ".\n\n"], k=n))


@pytest.mark.parametrize("seed", range(25))
def test_edits_give_the_count_of_the_edited_text(count, seed):
    rng = random.Random(seed)
    text = some_text(rng, rng.choice([0, 1, 5, 200, 900]))
    tree = TokenTree.of(text, count, leaf_chars=rng.choice([4, 16, 64]))
    assert tree.total() == count(text) and tree.text() == text
    for _ in range(12):
        a, b, new = rng.randint(0, len(text) + 2), rng.randint(0, 9), some_text(rng, rng.randint(0, 6))
        b = a + b
        tree.edit(a, b, new)
        text = text[:a] + new + text[max(a, b) :] if a <= len(text) else text + new
        assert tree.text() == text and tree.total() == count(text)


def test_only_the_region_is_encoded_again(count):
    text = "some words here and there " * 2000
    tree = TokenTree.of(text, count)
    tree.edit(30000, 30004, "WORDS")
    assert tree.total() == count(tree.text()) and tree.reencoded < 1200
    assert "".join(leaves_of(text)) == text and len(leaves_of(text)) > 150


def test_trees_are_kept_between_jobs(spark, docs_of, count):
    rng = random.Random(1)
    texts = [some_text(rng, 300) for _ in range(20)] + [None, ""]
    docs = docs_of(texts, clashing=True)
    trees = build_trees(docs).withColumnRenamed("doc_id", "k")
    edits = F.array(F.struct(F.lit(3).cast("long").alias("start"), F.lit(9).cast("long").alias("stop"), F.lit("new").alias("text"))).cast(EDITS)
    joined = docs.select("doc_id", "text").join(trees, F.col("doc_id") == F.col("k")).withColumn("e", F.when(F.col("doc_id") != 5, edits))
    for r in recount(joined, "e", leaf_chars="leaf_chars", leaf_tokens="leaf_tokens").collect():
        text = texts[r.doc_id]
        after = (text[:3] + "new" + text[9:] if r.doc_id != 5 else text) if text is not None else ""
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (count(text or ""), count(after), len(after))
        assert sum(r.leaf_tokens) == r.n_tokens_after and sum(r.leaf_chars) == len(after)


def test_scrubbing_counts(spark, docs_of, count):
    secret = "0123456789abcdef" * 2
    texts = [f"call 12345678 or 10.0.0.1 now, key {secret} end", "nothing", None, "", "a@b.co 1234567890123456 " * 2000]
    rows = {r.doc_id: r for r in recount(docs_of(texts), scrub_edits).collect()}
    import re

    for k, t in enumerate(texts):
        after = re.sub(r"\b[0-9a-f]{32,}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\d{7,}|[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[removed]", t or "")
        assert (rows[k].n_tokens, rows[k].n_tokens_after) == (count(t or ""), count(after))
    assert rows[0].n_edits == 3 and rows[4].n_edits == 4000
    assert recount(docs_of(["a"]).limit(0), scrub_edits).count() == 0 and build_trees(docs_of(["a"]).limit(0)).count() == 0


def test_leaves_of_texts_of_all_characters(count):
    # letters that only one of two Unicode versions knows must not end a leaf
    rng = random.Random(3)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x20000))] + [" "] * 3000 + list(".,'-") * 500
    for _ in range(60):
        text = "".join(rng.choices(every, k=800))
        leaves = leaves_of(text, 16)
        assert "".join(leaves) == text and sum(map(count, leaves)) == count(text) and len(leaves) > 8
    odd = "\u0558\u0558.\u0558,\u0558 " * 40
    assert sum(map(count, leaves_of(odd, 4))) == count(odd)


@pytest.mark.parametrize("unit", ["слово ", "漢字、かな。", "12345, ", "مرحبا ", "-- "])
def test_every_script_is_cut(count, unit):
    text = unit * 4000
    leaves = leaves_of(text)
    assert "".join(leaves) == text and sum(map(count, leaves)) == count(text) and max(map(len, leaves)) < 300
    tree = TokenTree.of(text, count)
    tree.edit(9000, 9003, "new")
    assert tree.total() == count(tree.text()) and tree.reencoded < 900


def test_a_long_insertion_gets_leaves_of_its_own(count):
    tree = TokenTree.of("some words here " * 100, count)
    tree.edit(500, 500, "inserted text, " * 2000)
    assert tree.total() == count(tree.text()) and max(map(len, tree.leaves)) < 300
    before = tree.reencoded
    tree.edit(9000, 9001, "x")
    assert tree.total() == count(tree.text()) and tree.reencoded - before < 900


def test_long_runs_and_equal_places(spark, docs_of, count):
    texts = ["x" + " " * 1_500_000 + "y", "ab " * 10, None]
    edits = F.array(*(F.struct(F.lit(2).cast("long").alias("start"), F.lit(2).cast("long").alias("stop"), F.lit(t).alias("text")) for t in ("1", "2"))).cast(EDITS)
    rows = {r.doc_id: r for r in recount(docs_of(texts, clashing=True).withColumn("e", edits), "e").collect()}
    assert rows[0].n_chars_after == 1_500_004 and rows[1].n_tokens_after == count("ab21 " + "ab " * 9) and rows[2].n_tokens == 0
