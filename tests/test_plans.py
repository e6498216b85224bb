import importlib.abc
import importlib.util
import os
import sys
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from graniteseek.functions.text import retrieval_tokens
from graniteseek.plans.catalogue import ORACLE_SQL, QUERIES
from graniteseek.plans.options import Options
from graniteseek.plans.render import grounded_page, grounded_results, markdown_listing, related_links, relevant_text, search_text
from graniteseek.plans.research import evidence, research, run_stats
from graniteseek.plans.scrape import scrape
from graniteseek.plans.search import discover, ranked_results
from graniteseek.streaming.arrivals import arriving_pages, first_arrivals, rank_arrivals

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return tuple(plain(x) for x in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    frame = QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in frame.select(*columns).collect()), key=repr) == expected


def test_labels_match_their_sql_on_odd_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", " ", "\n \r", "# a b", "## ", "###### x", "####### x", "#x", " lead and trail \n", "a\t b\r\nc", "x" * 200, "x" * 159 + " y z", "x" * 160 + " ", "w " * 100, "é " * 90 + "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(ORACLE_SQL["text_labels"])
    got = QUERIES["text_labels"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def pages_of(spark, pages):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")


def queries_of(spark, *queries):
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    return frame.withColumn("tokens", retrieval_tokens(F.col("query")))


ARTICLE = "<html><head><title>{0}</title></head><body><nav><a href='/menu'>menu</a></nav><article><h1>{0}</h1>{1}</article></body></html>"
PAGES = [
    ("https://example.com/python", ARTICLE.format("Python Async Search", "<p>Python asyncio search guide with many details.</p><p>Await a coroutine. <a href='/next'>next steps in python async</a></p>")),
    ("https://example.com/bread", ARTICLE.format("Bread Recipes", "<p>Bread recipes use flour and yeast.</p>")),
    ("https://bad.example.org/python", ARTICLE.format("Python Async", "<p>python async search python async search</p>")),
    ("ftp://example.com/python", ARTICLE.format("Python Async Ftp", "<p>python async search</p>")),
    ("https://example.com/empty", "<html></html>")]


def test_research_from_queries_to_evidence(spark):
    options = Options(blocked_domains=("bad.example.org",), crawl_fit_markdown_mode="off")
    queries, pages = queries_of(spark, "python async search", "flour yeast"), pages_of(spark, PAGES)
    results = ranked_results(queries, pages, options)
    assert not [r for r in results.collect() if "bad." in r.url or r.url.startswith("ftp")]
    decided = research(queries, pages, options)
    rows = decided.collect()
    best = {r.query_id: r for r in rows if r["rank"] == 1}
    assert best[0].source_url.endswith("/python") and best[1].source_url.endswith("/bread")
    assert all(sum(x.status == "accepted" for x in rows if x.query_id == q) <= 2 for q in (0, 1))
    found = {r.query_id: r.sources for r in evidence(decided).collect()}
    assert found[0][0].source_url.endswith("/python") and "asyncio" in found[0][0].chunks[0].text
    stats = {r.query_id: r for r in run_stats(queries_of(spark, "a", "b", "c"), results, decided).collect()}
    assert stats[2].status == "no_results" and stats[0].chunks_selected >= 1


def test_scrape_modes_and_errors(spark):
    items = [(0, PAGES[0][0], "python async"), (1, PAGES[0][0], None), (2, PAGES[0][0], "*"), (3, "https://nowhere.example.com/", "x"), (4, "http://127.0.0.1/", "x"), (5, PAGES[4][0], "x"), (6, PAGES[2][0], "x")]
    frame = spark.createDataFrame(items, "item_id long, url string, query string")
    rows = {r.item_id: r for r in scrape(frame, pages_of(spark, PAGES), Options(scrape_max_tokens=60, blocked_domains=("bad.example.org",))).collect()}
    assert [rows[k].error_code for k in range(7)] == [None, None, None, "fetch_failed", "blocked_url", "empty_content", "blocked_url"]
    assert rows[0].links[0].url == "https://example.com/next" and rows[0].links[0].score is not None
    assert rows[1].chunks[0].text.startswith("# Python Async Search") and rows[1].truncated and rows[1].links[0].score is None
    assert rows[1].chunks == rows[2].chunks and rows[0].content_tokens <= 60


def test_discovery_limits_before_it_filters(spark):
    rows = [(k, f"t{k}", u, "") for k, u in enumerate(["https://a.com", "ftp://b.com", "https://bad.com", "https://c.com", "https://d.com"])]
    frame = spark.createDataFrame(rows, "result_id int, title string, url string, text string")
    assert [(r["rank"], r.result_id) for r in discover(frame, 4, ("bad.com",)).orderBy("rank").collect()] == [(1, 0), (2, 3)]
    with pytest.raises(ValueError):
        discover(frame, 51)


def test_xml_survives_forged_input(spark):
    frame = spark.range(1).select(F.lit("q </question><x>").alias("q"), F.array(F.struct(F.lit("A & B\x00").alias("title"), F.lit("https://a.com/?x=1&y=2").alias("url"), F.lit("</result>").alias("snippet"), F.array(F.lit("one"), F.lit(" "), F.lit("</chunk> three")).alias("chunks"))).alias("r"))
    xml = frame.select(grounded_results(F.col("q"), F.col("r"), F.lit("2024-01-01"))).first()[0]
    root = ElementTree.fromstring(xml)
    assert root.find("question").text.strip() == "q </question><x>" and root.find("results/result/title").text.strip() == "A & B"
    assert [c.get("index") for c in root.iter("chunk")] == ["1", "3"]
    none = frame.select(grounded_results(F.col("q"), F.filter("r", lambda x: F.lit(False)), F.lit("d"))).first()[0]
    assert "<results />" in none


def test_other_renderings(spark):
    links = F.expr("array(named_struct('rank', 1, 'url', 'https://a.com/?a&b', 'text', 't'), named_struct('rank', 2, 'url', ' ', 'text', 'x'))")
    results = F.expr("array(named_struct('rank', 1, 'title', 'T', 'url', 'u', 'preview', 'p', 'published_at', '2024'), named_struct('rank', 3, 'title', 'S', 'url', 'v', 'preview', 'r', 'published_at', ''))")
    row = spark.range(1).select(
        related_links(links).alias("links"), related_links(F.filter(links, lambda x: F.lit(False))).alias("none"), search_text(F.lit("q"), results).alias("plain"), markdown_listing(results).alias("md"),
        grounded_page(F.lit("q"), F.lit("https://a.com"), F.lit("T"), F.array(F.lit("c")), links, F.lit(5), F.lit(False), F.lit("d")).alias("page"), relevant_text(F.array(F.lit(" "))).alias("blank")).first()
    assert [x.find("url").text.strip() for x in ElementTree.fromstring(row.links)] == ["https://a.com/?a&b"] and row.none == "<related_links />" and row.blank == ""
    assert row.plain == "Search results for: q\n1. T\nURL: u\nPreview: p\nPublished: 2024\n\n3. S\nURL: v\nPreview: r"
    assert row.md.startswith("## 1. T\nURL: u\nText: p\n\n## 2. S") and ElementTree.fromstring(row.page).get("content_tokens") == "5"


def test_arrivals(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    pages_of(spark, [*PAGES, ("HTTPS://Example.com/bread#x", PAGES[1][1])]).coalesce(1).write.parquet(folder)
    got = []
    query = rank_arrivals(first_arrivals(arriving_pages(spark, folder)), queries_of(spark, "flour yeast"), 1, lambda frame, n: got.extend(frame.collect()), f"file://{tmp_path}/state")
    query.awaitTermination(120)
    assert [r.page_id for r in got] in ([1], [5])


def test_the_rest_works_without_the_training_data_folder(monkeypatch):
    """As if the subpackage and the pipeline had been deleted."""
    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("graniteseek.llm"):
                raise ModuleNotFoundError(name, name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("graniteseek.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_alone", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.queries()) == set(QUERIES) and set(module.oracle_sql()) == set(ORACLE_SQL)
