import ipaddress
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graniteseek.functions.text import retrieval_tokens
from graniteseek.operators.budget import first_per_source, within_budget
from graniteseek.operators.chunking import pruned
from graniteseek.operators.ranking import bm25_column, bm25_scores, bm25_top, global_rank, hybrid_rank, rank_by
from graniteseek.operators.urls import blocked_list, drop_blocked, fetch_code, is_private_literal, safety_code
from graniteseek.plans.catalogue import ORACLE_SQL, QUERIES
from graniteseek.plans.options import Options, checked_batch
from graniteseek.plans.render import prompt
from graniteseek.plans.research import local_search, savings_total
from graniteseek.plans.scrape import batch_items, read_items, scrape
from graniteseek.sources.payloads import backend_errors, dispatch, parse_results, search_errors, with_fallback


def closed(host):
    try:
        a = ipaddress.ip_address(host.strip("[]").partition("%")[0])
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified


def test_address_literals_are_judged_without_python(spark):
    rng = random.Random(1)
    hosts = ["127.0.0.1", "8.8.8.8", "192.0.0.9", "192.0.0.8", "172.15.9.9", "172.16.0.0", "172.32.0.0", "100.64.0.1", "255.255.255.255", "1.2.3", "01.2.3.4", "256.1.1.1", "example.com", "", "[::1]", "[::]", "[fe80::1%eth0]", "[fc00::1]", "[ff02::1]", "[2001:db8::1]", "[2001:4860:4860::8888]", "[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[::ffff:a00:1]", "[::ffff:808:808]", "[2002::1]", "[3fff::1]", "[3fff:1000::1]", "[2001:1ff::]", "[2001:200::]", "[2001:20::1]", "[64:ff9b::1]", "[1:2:3:4:5:6:7:8]", "[2a00::1:2:3:4:5:6]", "[zz]"]
    hosts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(400)]
    hosts += [f"[{ipaddress.IPv6Address((rng.choice([0x2001, 0x2002, 0x2A00, 0x3FFF, 0xFE80, 0xFC00, 0x2600, 0]) << 112) | rng.getrandbits(rng.choice([16, 60, 112])))}]" for _ in range(200)]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: r.x for r in frame.select("host", is_private_literal(F.col("host")).alias("x")).collect()}
    assert {h: closed(h) for h in hosts} == got
    plan = frame.select(safety_code(F.concat(F.lit("http://"), "host"))).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_why_a_url_is_not_fetched(spark):
    urls = ["https://a.com/", "ftp://a.com/", "https://sub.bad.com/x", "https://private.com/", "https://mixed.com/", "https://unknown.com/", "https://8.8.8.8/", "https://10.0.0.1/", None]
    dns = spark.createDataFrame([("a.com", "8.8.8.8"), ("sub.bad.com", "8.8.4.4"), ("private.com", "10.1.1.1"), ("mixed.com", "8.8.8.8"), ("mixed.com", "127.0.0.1")], "host string, address string")
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string")
    got = {r.k: r.code for r in fetch_code(frame, "code", "url", blocked_list(spark, ["bad.com"]), dns).collect()}
    assert got == {0: "ok", 1: "invalid_url", 2: "blocked_url", 3: "blocked_url", 4: "blocked_url", 5: "fetch_failed", 6: "ok", 7: "blocked_url", 8: "invalid_url"}


PAGE = "<title>t</title><article><h1>Python</h1><p>python async search python</p><p>bread and flour</p></article>"


def test_redirects_and_failed_fetches(spark):
    rows = [(0, "https://a.com/", "https://a.com/final", PAGE, None), (1, "https://b.com/", "https://bad.com/", PAGE, None), (2, "https://c.com/", "http://127.0.0.1/", PAGE, None), (3, "https://d.com/", None, None, "timeout"), (4, "https://e.com/", None, None, "refused"), (5, "https://f.com/", None, "", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, final_url string, html string, fetch_error string")
    items = spark.createDataFrame([(r[0], r[1], None) for r in rows] + [(9, "https://none.com/", None)], "item_id int, url string, query string")
    got = {r.item_id: r.error_code for r in read_items(items, pages, blocked_list(spark, ["bad.com"])).collect()}
    assert got == {0: None, 1: "blocked_url", 2: "blocked_url", 3: "fetch_timeout", 4: "fetch_failed", 5: "empty_content", 9: "fetch_failed"}


def test_pages_of_one_url_are_items_apart(spark):
    url, more = "https://a.com/", "<article><p>other words</p></article>"
    pages = spark.createDataFrame([(1, url, PAGE), (2, url, more), (3, "https://b.com/", PAGE)], "page_id int, url string, html string")
    items = pages.select((F.col("page_id") + 10).alias("item_id"), "page_id", "url", F.lit(None).cast("string").alias("query"))
    got = sorted((r.item_id, "other" in r.markdown) for r in read_items(items, pages).collect())
    assert got == [(11, False), (12, True), (13, False)]
    # by urls alone: one row an item, of the first page
    got = sorted((r.item_id, "other" in r.markdown) for r in read_items(items.drop("page_id"), pages.orderBy(F.desc("page_id"))).collect())
    assert got == [(11, False), (12, False), (13, False)]


@pytest.mark.parametrize("name", ["link_rank", "page_order_extract", "scrape_chunks"])
def test_reads_match_their_sql_where_a_url_stands_twice(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(12)
    twice = F.when(F.col("page_id") % 3 == 1, F.first("url").over(Window.orderBy("page_id"))).otherwise(F.col("url"))
    rows.withColumn("url", twice).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_a_focused_read_uses_the_blocks_that_matter(spark):
    body = "".join(f"<p>block {k} about nothing in particular at all</p>" for k in range(30))
    pages = spark.createDataFrame([(0, "https://a.com/", f"<title>t</title><article>{body}<p>zebra crossing zebra</p></article>")], "page_id int, url string, html string")
    items = batch_items(spark, [{"url": "https://a.com/", "query": "zebra"}, {"url": "https://a.com/"}])
    got = {r.item_id: r for r in scrape(items, pages, Options()).collect()}
    assert [c.text for c in got[0].chunks] == ["zebra crossing zebra"] and "block 29" in got[1].chunks[0].text
    whole = {r.item_id: r for r in scrape(items, pages, Options(crawl_fit_markdown_mode="off")).collect()}
    assert "block" in whole[0].chunks[0].text or len(whole[0].chunks) > 1


def test_prose_is_kept_by_pruning(spark):
    text = "# Head\n\nThis is a long enough line of prose that reads like an article, and it goes on.\n\n12 | 34 | 56\n\nHome"
    assert spark.range(1).select(pruned(F.lit(text))).first()[0] == "\n\n".join(text.split("\n\n")[:2])


@pytest.mark.parametrize("items", [[], [{"url": "u"}] * 6, [{"url": ""}], [{"url": 1}], [{}], [{"url": "u", "query": 1}], [{"url": "u", "max_tokens": 0}], [{"url": "u", "max_tokens": True}], "u"])
def test_batches_are_checked(items):
    with pytest.raises(ValueError):
        checked_batch(items)


def test_backends_that_fail(spark):
    body = '{"results":[],"unresponsive_engines":["x"]}'
    fine = '{"results":[{"title":"T","url":"https://t.com/"}]}'
    first = spark.createDataFrame([(1, body, 200), (2, fine, 200), (3, fine, 429), (4, "no json", 200), (5, '{"results":[]}', 200), (6, fine, 500)], "query_id int, body string, status int")
    errors = {"searxng": backend_errors(first, "searxng")}
    assert {r.query_id: r.error_code for r in errors["searxng"].collect()} == {1: "backend_blocked", 3: "backend_blocked", 4: "backend_failed", 6: "backend_failed"}
    second = spark.createDataFrame([(3, '[{"title":"D","href":"https://d.com/","body":""}]')], "query_id int, body string")
    results = {"searxng": parse_results(first.drop("status"), "searxng"), "ddgs": parse_results(second, "ddgs")}
    asked = first.select("query_id")
    found = with_fallback(results, dispatch("searxng"), asked, errors)
    assert sorted((r.query_id, r.backend) for r in found.collect()) == [(2, "searxng"), (3, "ddgs")]
    assert sorted((r.query_id, r.error_code) for r in search_errors(found, asked, errors, dispatch("searxng")).collect()) == [(1, "backend_blocked"), (4, "backend_failed"), (6, "backend_failed")]


def test_prompts_by_operation(spark):
    row = spark.range(1)
    text = row.select(prompt("current_datetime", F.lit("1"), now=F.current_timestamp())).first()[0]
    assert text.startswith("<current_datetime>")
    with pytest.raises(ValueError, match="no prompt"):
        prompt("other", F.lit("1"))
    with pytest.raises(Exception, match="unsupported schema version 2"):
        row.select(prompt("current_datetime", F.lit("2"), now=F.current_timestamp())).collect()


def test_places_over_a_whole_table(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([(k, rng.choice([0.0, 0.5, 0.25, rng.random()]), rng.choice([0.0, rng.random()])) for k in range(700)], "pos int, bm25_score double, dense_score double").repartition(5)
    got = {r.pos: r.place for r in global_rank(frame, "place", F.desc("bm25_score"), F.col("pos")).collect()}
    want = {r.pos: r.place for r in frame.withColumn("place", F.row_number().over(Window.orderBy(F.desc("bm25_score"), "pos"))).collect()}
    assert got == want
    columns = ["pos", "bm25_rank", "dense_rank", "rank"]
    one, other = (sorted(map(tuple, hybrid_rank(frame.withColumn("q", F.lit(1)), pool, cutoff=0.2).select(columns).collect())) for pool in ([], ["q"]))
    assert one == other and 0 < len(one) < 700


def test_the_best_of_a_corpus_are_those_of_all_scores(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)] + ["the"] * 30
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)] + [""] * 5
    corpus = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc int, text string").repartition(4).withColumn("tokens", retrieval_tokens(F.col("text")))
    queries = spark.createDataFrame([(k, " ".join(rng.choices(words, k=6))) for k in range(9)] + [(9, "nowhere"), (10, "")], "query_id int, query string").withColumn("tokens", retrieval_tokens(F.col("query")))
    got = sorted((r.query_id, r.rank, r.doc, round(r.bm25_score, 8)) for r in bm25_top(corpus, queries, "doc", "doc", "query_id", 7).collect())
    want = []
    for q in range(11):
        one = queries.filter(F.col("query_id") == q).select(F.lit(1).alias("pool"), "tokens")
        scored = bm25_scores(corpus.withColumn("pool", F.lit(1)), one, ["pool"], ["doc"])
        assert sorted((r.doc, round(r.bm25_score, 8)) for r in scored.collect()) == sorted((r.doc, round(r.bm25_score, 8)) for r in bm25_column(corpus, one.withColumn("q", F.lit(0)), "q").collect())
        rows = scored.withColumn("rank", rank_by(["pool"], "bm25_score", "doc")).filter("rank <= 7").collect()
        want += [(q, r["rank"], r.doc, round(r.bm25_score, 8)) for r in rows]
    assert got == sorted(want)


def test_names_of_helpers_may_stand_in_the_input(spark):
    names = ["place", "running", "blocked_host", "own_host", "part", "before", "n"]
    rows = spark.createDataFrame([(1, k, f"https://h{k}.com/", "text", 4) for k in range(4)], "pool int, rank int, url string, text string, tokens int").withColumns({n: F.lit(k) for k, n in enumerate(names)})
    assert drop_blocked(rows, blocked_list(rows.sparkSession, ["h1.com"])).columns == rows.columns
    out = within_budget(rows, ["pool"], "rank", 9)
    assert out.columns == [*rows.columns, "truncated"] and out.count() == 2
    assert first_per_source(rows, ["pool"], "url", "rank", 1).columns == rows.columns
    assert global_rank(rows, "r", F.col("rank")).drop("r").columns == rows.columns


def test_budget_in_tokens_of_a_vocabulary(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    rows = spark.createDataFrame([(1, 1, "several words of an overlong first chunk", 50)], "pool int, rank int, text string, tokens int")
    row = within_budget(rows, ["pool"], "rank", 3, tokenizer=path).first()
    assert row.truncated and row.tokens == 3 and len(row.text.split()) <= 3


def test_chunks_are_searched_and_savings_summed(spark):
    rows = spark.createDataFrame([(1, "# A\n\nzebra " + "x " * 200 + "\n\nlion"), (2, "bread")], "k long, text string")
    queries = spark.createDataFrame([(7, "zebra")], "query_id int, query string").withColumn("tokens", retrieval_tokens(F.col("query")))
    best = local_search(rows, queries, "text", "k", 2).orderBy("rank").collect()
    assert best[0].chunk_id.startswith("1:") and "zebra" in best[0].chunk_text and len(best) == 2
    savings = spark.createDataFrame([(1, 100, 20, 80), (2, 100, 60, 40)], "query_id int, naive_tokens long, returned_tokens long, tokens_saved long")
    assert tuple(savings_total(savings).first()) == (200, 80, 120, 60.0)


def test_embedders_are_held_to_their_texts(spark):
    import numpy as np

    from graniteseek.operators.embedding import embed_texts, pooled

    class Short:
        def embed(self, texts):
            return np.zeros((len(texts) - 1, 2))

    with pytest.raises(Exception, match="gave 1 vectors for 2 texts"):
        embed_texts(spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string").coalesce(1), ["k"], "text", Short()).collect()
    both = {"pooler": np.array([[1.0, 0.0]]), "last": np.array([[[0.0, 2.0], [5.0, 5.0]]])}
    assert pooled(both).tolist() == [[1.0, 0.0]] and pooled(both, pooling="cls").tolist() == [[0.0, 1.0]]
    with pytest.raises(ValueError):
        pooled(both, pooling="mean")


def test_hashed_cosines_in_batches(spark):
    from graniteseek.operators.ranking import hashed_dense_column
    from graniteseek.plans.search import with_dense

    texts = ["bread and flour", "python async python", "", "Search ranking combines signals"] * 3
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").withColumn("tokens", retrieval_tokens(F.col("text"))).withColumn("q", F.lit(0))
    query = spark.range(1).select(F.lit(0).alias("q"), retrieval_tokens(F.lit("python search search")).alias("tokens"))
    one = {r.doc: round(r.dense_score, 12) for r in hashed_dense_column(corpus, query).collect()}
    assert one == {r.doc: round(r.dense_score, 12) for r in with_dense(corpus, query, ["doc"], "q", "tokens").collect()}
    assert set(hashed_dense_column(corpus, query.limit(0)).select("dense_score").distinct().toPandas()["dense_score"]) == {0.0}
