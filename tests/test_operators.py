import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from graniteseek.functions.text import retrieval_tokens
from graniteseek.operators.budget import first_per_source, within_budget
from graniteseek.operators.chunking import chunks_of
from graniteseek.operators.dedupe import choose, lexical_survivors, select_with_quota, token_set
from graniteseek.operators.pages import admissible_links, metadata, page_struct, read_page
from graniteseek.operators.ranking import bm25_scores, bm25_top, cosine_top, hybrid_rank
from graniteseek.operators.urls import blocked_list
from graniteseek.sources.files import read_document
from graniteseek.sources.payloads import dispatch

TRIO = ["Bread recipes use flour and yeast.", "Python asyncio enables async search workflows.", "Search ranking combines lexical and dense signals."]


def okapi(texts, query):
    docs = [[t for t in __import__("re").findall(r"[a-zA-Z0-9_./:#-]+", x.lower())] for x in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split()) for d in docs]


def corpus_of(spark, texts):
    return spark.createDataFrame([(0, k, k, t) for k, t in enumerate(texts)], "pool int, key int, pos int, text string").withColumn("tokens", retrieval_tokens(F.col("text")))


@pytest.mark.parametrize("query", ["python async search", "search search and", "nothing here", "the"])
def test_bm25_matches_the_formula(spark, query):
    texts = [*TRIO, "the the the and", "", "the search of the"]
    asked = spark.createDataFrame([(0, query.split())], "pool int, tokens array<string>")
    got = {r.key: r.bm25_score for r in bm25_scores(corpus_of(spark, texts), asked, ["pool"], ["key"]).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(okapi(texts, query), abs=1e-10)


def test_top_k_fills_with_zero_scores_in_order(spark):
    texts = ["x", "y", "apple", "z"]
    asked = spark.createDataFrame([(7, ["apple"]), (8, ["none"])], "q int, tokens array<string>")
    rows = bm25_top(corpus_of(spark, texts).drop("pool"), asked, "key", "pos", "q", 3).collect()
    assert [(r.key) for r in sorted(rows, key=lambda r: r["rank"]) if r.q == 7] == [2, 0, 1]
    assert [(r.key) for r in sorted(rows, key=lambda r: r["rank"]) if r.q == 8] == [0, 1, 2]


def scored_trio(spark):
    rows = [(0, 0, 0.0, 0.0), (0, 1, 1.17, 1.0), (0, 2, 0.09, 0.97)]
    return spark.createDataFrame(rows, "pool int, pos int, bm25_score double, dense_score double")


def test_hybrid_order_cutoff_and_dense_only(spark):
    ranked = hybrid_rank(scored_trio(spark), ["pool"]).orderBy("rank").collect()
    assert [r.pos for r in ranked] == [1, 2, 0] and ranked[0].rrf_similarity == pytest.approx(1.0)
    assert [r.pos for r in hybrid_rank(scored_trio(spark), ["pool"], cutoff=0.98, top_k=1).collect()] == [1]
    assert hybrid_rank(scored_trio(spark), ["pool"], dense_weight=1.0).filter("rank = 1").first().rrf_similarity == pytest.approx(1.0)
    for weight in (0, 1.1):
        with pytest.raises(ValueError):
            hybrid_rank(scored_trio(spark), ["pool"], dense_weight=weight)


def test_ties_fall_to_input_order(spark):
    frame = spark.createDataFrame([(0, p, 0.0, 0.0) for p in (3, 1, 2)], "pool int, pos int, bm25_score double, dense_score double")
    assert [r.pos for r in hybrid_rank(frame, ["pool"]).orderBy("rank").collect()] == [1, 2, 3]


def test_cosine_top(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "v int, e array<double>")
    rows = cosine_top(frame, frame.filter("v = 0").withColumnRenamed("v", "q"), "v", "e", "q", "e", 2).orderBy("rank").collect()
    assert [r.v for r in rows] == [0, 1]


def test_queries_go_in_blocks(spark, monkeypatch):
    from graniteseek.operators import ranking

    frame = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)], "v int, e array<double>")
    asked = frame.withColumnRenamed("v", "q")
    whole = sorted(tuple(r) for r in cosine_top(frame, asked, "v", "e", "q", "e", 3).collect())
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 9)
    assert sorted(tuple(r) for r in cosine_top(frame, asked, "v", "e", "q", "e", 3).collect()) == whole


def test_lexical_duplicates():
    assert lexical_survivors(["a b c", "a b c", "d"], 0.9) == [0, 2]
    assert lexical_survivors(["a", "a"], 1.0) == [0, 1]
    assert lexical_survivors(["日本", "日本", "中国", "word", ""], 0.9) == [0, 2, 3, 4]


def test_survivors_are_pairwise_apart():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 6))) for _ in range(80)]
    kept = lexical_survivors(texts, 0.7)
    for i, a in enumerate(kept):
        for b in kept[:i]:
            x, y = token_set(texts[a]), token_set(texts[b])
            assert not x or not y or len(x & y) / len(x | y) < 0.7


def test_quota_then_fill():
    ids, urls = ["u1:a", "u1:b", "u1:c", "u2:a", "u2:b"], ["1", "1", "1", "2", "2"]
    texts = [f"w{k} x{k}" for k in range(5)]
    chosen, _ = choose(ids, texts, urls, [None] * 5, 4, 1, 0.9, 0.9)
    assert [ids[k] for k, _ in chosen] == ["u1:a", "u2:a", "u1:b", "u1:c"] and [q for _, q in chosen] == [True, True, False, False]


@pytest.mark.parametrize(("threshold", "enabled", "want"), [(0.9, True, [0, 2]), (0.99, True, [0, 1, 2]), (0.9, False, [0, 1, 2])])
def test_paraphrases(threshold, enabled, want):
    vectors = [[1, 0, 0], [0.96, 0.28, 0], [0, 0, 1]]
    chosen, rejected = choose("abc", ["p q", "r s", "t u"], "xyz", vectors, 3, 0, 0.9, threshold, enabled)
    assert [k for k, _ in chosen] == want
    if want == [0, 2]:
        assert rejected[1][1] == "a" and rejected[1][0] == pytest.approx(0.96)


@pytest.mark.parametrize(("cap", "want"), [(1, [0, 2, 3]), (9, [0, 1, 3])])
def test_acceptance_depends_on_order(cap, want):
    vectors = [[1, 0], [0, 1], [0.01, 1], [1, 1]]
    chosen, _ = choose(range(4), ["a", "b", "c", "d"], ["a", "a", "b", "c"], vectors, 3, cap, 1.0, 0.9)
    assert sorted(k for k, _ in chosen) == want


def test_selection_over_pools(spark):
    rows = [(1, "a", "x y", "s", 1, [1.0, 0.0]), (1, "b", "x y", "s", 2, [0.0, 1.0]), (2, "c", "z", "s", 1, None)]
    pools = spark.createDataFrame(rows, "query_id int, chunk_id string, text string, source_url string, rank int, vector array<double>")
    got = {r.chunk_id: r.status for r in select_with_quota(pools, "query_id", 2).collect()}
    assert got == {"a": "accepted", "b": "lexical_duplicate", "c": "accepted"}
    assert select_with_quota(pools.limit(0), "query_id", 2).count() == 0


def test_chunks_carry_the_heading_in_force_when_closed():
    text = "# A\n\naaa\n# B\nbbb"
    got = chunks_of(text, 10, 2)
    assert [(c[0], c[1]) for c in got] == [(0, "B\nbbb"), (1, "B\nbbb")]
    assert [c[2] for c in chunks_of("one\n\ntwo\n\n\nthree", 8, 2)] == ["one\n\ntwo", "three"]


def test_oversized_blocks_become_windows():
    got = chunks_of("short\n\n" + "x" * 25, 10, 4)
    assert [c[3] for c in got] == [5, 10, 10, 10, 7, 1] and got[0][2] == "short"
    assert chunks_of("", 10, 2) == [] and chunks_of(None, 10, 2) == []


def budgeted(spark, sizes, budget):
    frame = spark.createDataFrame([(0, k, "x" * n, n) for k, n in enumerate(sizes, 1)], "pool int, rank int, text string, tokens int")
    return [(r["rank"], r.tokens, r.truncated, len(r.text)) for r in within_budget(frame, ["pool"], "rank", budget).orderBy("rank").collect()]


def test_budget_stops_at_the_first_overflow(spark):
    assert budgeted(spark, [3, 9, 1], 5) == [(1, 3, False, 3)]
    assert budgeted(spark, [9, 1], 5) == [(1, 5, True, 5)]
    assert budgeted(spark, [2, 3], 5) == [(1, 2, False, 2), (2, 3, False, 3)]


def test_first_per_source(spark):
    frame = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, "b", 3)], "pool int, source string, rank int")
    assert sorted(r["rank"] for r in first_per_source(frame, ["pool"], "source", "rank", 1).collect()) == [1, 3]


def test_page_reading():
    page = read_page('<title>T &amp; U</title><meta content="d" name="Description"><meta property="og:description" content="o"><nav>menu</nav><h2>Head</h2><p>Some <b>text</b> <a href="/x">link</a></p><script>no</script><a href="/open">never closed')
    assert page["title"] == "T & U" and page["meta"]["description"] == "d" and page["markdown"].startswith("## Head\n\nSome text link")
    assert [x["href"] for x in page["links"]] == ["/x"] and page["links"][0]["context"].endswith("Some text ")
    assert read_page(None)["markdown"] == "" and read_page("")["links"] == []


def test_only_complete_character_references_are_decoded():
    page = read_page('<article><h1>und&amp;&amp; &lt;b&gt; ver&amp</h1><p>a &copy 1 &notit; &#233;&#xe9; &eacute; & b</p><a href="/x?a=1&copy=2&amp;b=3">l&lt</a></article>')
    assert page["markdown"] == "# und&& <b> ver&amp\n\na &copy 1 &notit; éé é & b\n\nl&lt"
    assert [(k["href"], k["text"]) for k in page["links"]] == [("/x?a=1&copy=2&b=3", "l&lt")] and page["links"][0]["context"].startswith("und&& <b> ver&amp")


def test_a_page_is_parsed_once(spark):
    frame = spark.createDataFrame([('<a href="/x">l</a>',)], "html string").select(page_struct(F.col("html")).alias("p")).select(F.explode("p.links").alias("l"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and frame.first().l.href == "/x"


def test_metadata_precedence(spark):
    frame = spark.createDataFrame([('<meta property="og:description" content="o"><meta name="author" content="w">',)], "html string").select(page_struct(F.col("html")).alias("p"))
    assert tuple(frame.select(*metadata(F.col("p.meta"))).first()) == ("o", "w", None)


def test_link_admission(spark):
    hrefs = ["/a", "#top", "javascript:x", "/a#frag", "HTTPS://H.com/a", "https://bad.com/x", "", "b", "https://h.com/page"]
    rows = [(1, "https://h.com/page", k, h, "t" * 200 if k == 0 else " two  words ", "c") for k, h in enumerate(hrefs)]
    frame = spark.createDataFrame(rows, "page_id int, url string, pos int, href string, text string, context string")
    got = admissible_links(frame, blocked=blocked_list(spark, ["bad.com"])).orderBy("pos").collect()
    assert [(r.pos, r.url) for r in got] == [(0, "https://h.com/a"), (7, "https://h.com/b")]
    assert len(got[0].text) == 161 and got[1].text == "two words"


def test_documents_as_files():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    assert read_document("docx", data.getvalue()) == ("Hello\n\na | b", None)
    assert read_document("doc", b"")[1] == "unsupported_document" and read_document("docx", b"junk")[1] == "fetch_failed"


@pytest.mark.parametrize(("args", "want"), [
    (("searxng", True, False), ("searxng", ("ddgs",))), (("searxng", True, True), ("searxng", ("ddgs", "brave"))), (("searxng", False, True), ("searxng", ())),
    (("auto", False, True), ("searxng", ("ddgs",))), (("duckduckgo", True, True), ("ddgs", ("brave",))), (("odd", True, False), ("searxng", ("ddgs",)))])
def test_dispatch(args, want):
    got = dispatch(*args)
    assert (got.primary, got.fallbacks) == want


def test_options(tmp_path):
    from graniteseek.plans.options import Options, checked_limit, redacted

    path = str(tmp_path / "c.json")
    Options.of({"scrape_max_tokens": "7", "chunk_semantic_dedupe_enabled": "no", "blocked_domains": "a.com, ,b.com,a.com", "unknown": 1}).save(path)
    got = Options.load(path, {"GRANITESEEK_SEARCH_TOP_K": "3"})
    assert (got.scrape_max_tokens, got.chunk_semantic_dedupe_enabled, got.blocked_domains, got.search_top_k) == (7, False, ("a.com", "b.com"), 3)
    assert json.loads(open(path).read())["search_top_k"] == 10
    assert redacted({"x_api_key": "k", "max_tokens": 5, "n": "v"}) == {"x_api_key": "***", "max_tokens": 5, "n": "v"}
    with pytest.raises(ValueError):
        checked_limit(51)
