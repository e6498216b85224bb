import json
import os

import pytest
from pyspark.sql import functions as F

from graniteseek.sources.backends import GAVE_UP, SearchSource, TraceSource, ask_in_turn, asked, write_trace
from graniteseek.sources.payloads import dispatch, search_errors


def fetch(backend, query):
    """A backend without a network; calls are counted in files, as tasks are processes of their own."""
    folder = os.environ.get("CALLS_OF_TEST")
    if folder:
        with open(os.path.join(folder, f"{os.getpid()}"), "a") as out:
            out.write(query + "\n")
    if query == "down":
        raise ConnectionError("no route")
    if query == "refused":
        return 403, None
    if backend == "searxng":
        return 200, json.dumps({"results": [] if query == "rare" else [{"title": query, "url": "https://a.com/" + query}], "unresponsive_engines": []})
    return 200, json.dumps([{"title": query, "href": "https://b.com/" + query, "body": "x"}])


@pytest.fixture()
def search(spark):
    spark.dataSource.register(SearchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("search").options(backend="searxng", fetch="tests.test_backends:fetch", per_task="2").load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_the_queries_of_the_filter_are_asked(search):
    rows = search.filter(F.col("query").isin("a", "b", "c", "refused", "down"))
    assert rows.rdd.getNumPartitions() == 3
    got = {r.query: (r.status, r.body) for r in rows.collect()}
    assert set(got) == {"a", "b", "c", "refused", "down"} and got["refused"] == (403, None) and got["down"] == (GAVE_UP, None)
    assert json.loads(got["a"][1])["results"][0]["url"] == "https://a.com/a"
    one = search.filter("query = 'a' and status = 200")
    assert [r.query for r in one.collect()] == ["a"]
    assert search.filter((F.col("query") == "a") & F.col("query").isin("b", "c")).count() == 0


def test_a_read_of_everything_is_refused(search):
    with pytest.raises(Exception, match="filter on `query`"):
        search.count()


def test_options_are_checked(spark):
    spark.dataSource.register(SearchSource)
    with pytest.raises(Exception, match="fetch"):
        spark.read.format("search").options(backend="searxng").load().filter("query = 'a'").collect()


def test_later_sources_are_asked_for_what_is_left_only(spark):
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(["a", "rare", "down", "refused", None])], "query_id int, query string")
    sent = {}

    def source(backend):
        def ask(left):
            sent[backend] = {r.query_id for r in left.collect()}
            return asked(left, backend, "tests.test_backends:fetch")

        return ask

    rows, errors = ask_in_turn({b: source(b) for b in ("searxng", "ddgs", "brave")}, dispatch("searxng", True, False), queries)
    assert {(r.query_id, r.url, r.backend) for r in rows.collect()} == {(0, "https://a.com/a", "searxng"), (1, "https://b.com/rare", "ddgs")}
    assert sent == {"searxng": {0, 1, 2, 3, 4}, "ddgs": {1, 2, 3, 4}}
    why = {r.query_id: r.error_code for r in search_errors(rows, queries, errors, dispatch("searxng", True, False)).collect()}
    assert why == {2: "backend_failed", 3: "backend_blocked", 4: "backend_failed"}
    sent.clear()
    ask_in_turn({b: source(b) for b in ("searxng", "ddgs")}, dispatch("searxng", True, False), queries.filter("query = 'a'"))
    assert sent == {"searxng": {0}}
    with pytest.raises(ValueError):
        ask_in_turn({}, dispatch("searxng"), queries)


def parts(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


def test_traces_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "traces")
    rows = spark.range(0, 40, 1, 4).select("id", F.struct(F.lit("é").alias("x"), F.col("id").alias("y")).alias("record"))
    write_trace(rows, path)
    assert len(parts(path)) == 4 and os.path.exists(path + "/_SUCCESS")
    assert sorted(r.record.y for r in spark.read.json(path).collect()) == list(range(40))
    before = parts(path)

    bad = rows.withColumn("id", F.when(F.col("id") == 35, F.raise_error(F.lit("task fails")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="task fails"):
        write_trace(bad, path)
    assert parts(path) == before and not [f for f in os.listdir(path) if f.startswith("_temporary")]
    write_trace(rows.limit(3), path)  # another run takes the place of the last
    assert spark.read.json(path).count() == 3
    rows.limit(2).write.format("trace").mode("append").save("file://" + path)
    assert spark.read.json(path).count() == 5
    write_trace(rows.limit(0), str(tmp_path / "none"))
    assert parts(str(tmp_path / "none")) == []
    write_trace(rows, "")
    assert TraceSource.name() == "trace"
