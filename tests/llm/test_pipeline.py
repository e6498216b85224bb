import random

import pytest

import __spark_entry__
import corpus_pipeline
from graniteseek.llm.packing import unpack


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das nicht ist ein mit auf zu".split()}
    item = " ".join(f"q{k}" for k in range(12))
    rows = []
    for k in range(300):
        lang = rng.choice(["en", "de"])
        rows.append((k, " ".join(rng.choice(words[lang]) + str(rng.randrange(400)) for _ in range(rng.randint(20, 80))), lang, f"s{k % 3}", 0))
    rows += [(300, rows[0][1], "en", "s0", 0), (301, rows[1][1] + " more", "en", "s1", 0), (302, f"intro {item} outro", "en", "s0", 0), (303, None, "en", "s0", 0), (304, "12 34", "en", "s0", 0), (None, "the of and loose", "en", None, 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return str(path), rows


def test_each_stage_on_its_own_input(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.collect()})
    every = {r[0] for r in rows}
    assert every - kept[0] == {303, 304}
    assert every - kept[1] == {300, 301}
    assert every - kept[2] == {302}


def test_whole_run(spark, folder):
    path, rows = folder
    got = unpack(corpus_pipeline.run(spark, path))
    texts = {r[0]: r[1] for r in rows}
    assert set(got) <= set(texts) - {300, 301, 302, 303, 304} and len(got) > 100
    # a document taken n times stands n times in its pieces
    assert all(t and g == t * (len(g) // len(t)) for t, g in ((texts[k], g) for k, g in got.items()))


def test_registration():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_tables(spark, docs_of, folder, number):
    path, rows = folder
    name, stage = corpus_pipeline.STAGES[number]
    last = number + 1 == len(corpus_pipeline.STAGES)
    empty = docs_of(["a"], clashing=True).limit(0)
    out = stage(spark, empty, path)
    assert out.count() == 0 and (last or out.columns == empty.columns)
    # repeated rows, null and empty texts, null ids, languages and sources, a very long text, clashing names
    long = "the of and to in is that it was for " * 20_000
    texts = [rows[0][1], rows[0][1], None, None, "", "", "!?", long, long + "end", rows[1][1], rows[2][1], rows[2][1]]
    ids = [1, 1, 2, None, 3, 4, 5, 6, 7, None, 8, 9]
    docs = docs_of(texts, ids=ids, langs=[None, "en", "en", None, "en", "en", "en", "en", "en", None, "de", "en"], sources=["s", "s", None, "t", "s", "t", None, "u", "u", None, "t", "t"], clashing=True)
    out = stage(spark, docs, path)
    if last:
        got = unpack(out.filter("size(doc_ids) > 0"))
        assert {1, 5, 6, 7, 8, 9} <= set(got) and not {2, 3, 4} & set(got) and got[6] == long
        return
    assert out.columns == docs.columns
    got = sorted(str(r.doc_id) for r in out.collect())
    if name == "language_id":
        assert got == sorted(["1", "1", "6", "7", "None", "8", "9"])
    elif name == "near_dedup":
        assert got == sorted(["1", "2", "3", "5", "6", "None", "None", "8"])
    elif name == "decontaminate":
        assert got == sorted(map(str, ids))
    else:
        assert set(got) <= set(map(str, ids)) and not {"2", "3", "4"} & set(got) and len(got) >= 3


def test_no_labels_keep_what_has_letters(spark, docs_of, folder):
    docs = docs_of(["some words", "12 34", None, "mehr Wörter"], langs=[None] * 4)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, folder[0]).collect()} == {0, 3}
