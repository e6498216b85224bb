"""Discovery: result rows filtered and numbered, without models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import collapsed, retrieval_tokens
from ..functions.urls import is_http, url_domain
from ..functions.vectors import cosine, hash_vectors
from ..operators.pools import pool_scores
from ..operators.ranking import bm25_top, hybrid_rank
from ..operators.urls import blocked_list, drop_blocked
from ..sources.staging import staged
from .options import Options, checked_limit
from .progress import Progress


def page_title(html: Column) -> Column:
    """The title element's text; enough to rank by, without parsing the page."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, said in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(name), F.lit(said))
    return collapsed(raw)


def page_snippet(html: Column, chars: int = 200) -> Column:
    """What a backend shows of a page: the first characters of its article's text."""
    body = F.regexp_extract(html, r"(?is)<article[^>]*>(.*)", 1)
    return F.substring(collapsed(F.regexp_replace(body, r"(?s)<[^>]*>?", " ")), 1, chars)


def page_words(html: Column) -> Column:
    """All text of the page, without scripts, styles and marks: what a backend finds it by."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), r"(?s)<[^>]*>", " ")


def pages_as_results(pages: DataFrame) -> DataFrame:
    """result_id, title, url, text (the snippet), html of every page, in page order."""
    return pages.select(F.col("page_id").alias("result_id"), page_title(F.col("html")).alias("title"), "url", page_snippet(F.col("html")).alias("text"), "html")


def discover(results: DataFrame, limit: int, blocked: tuple[str, ...] = (), pool: tuple[str, ...] = ()) -> DataFrame:
    """Results with rank: the backend's first `limit` with title and url, less what isn't http or is blocked.

    The limit applies before the filters, so fewer rows can come back; ranks have no gaps.
    """
    rows = results.filter("title <> '' AND url <> ''")
    if pool:
        place = F.row_number().over(Window.partitionBy(*pool).orderBy("result_id"))
        n, = fresh(rows, "n")
        rows = rows.withColumn(n, place).filter(F.col(n) <= checked_limit(limit)).drop(n)
    else:
        rows = rows.orderBy("result_id").limit(checked_limit(limit))
    rows = rows.filter(is_http(F.col("url")))
    if blocked:
        rows = drop_blocked(rows, blocked_list(rows.sparkSession, blocked))
    # at most 50 rows without a pool
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(pool or (F.lit(0),))).orderBy("result_id")))


def search_document(title: Column, url: Column, snippet: Column) -> Column:
    """What a result is ranked by."""
    return F.concat(F.lit("Title: "), title, F.lit("\nURL: "), url, F.lit("\nDomain: "), url_domain(url), F.lit("\nSnippet: "), snippet)


def with_dense(rows: DataFrame, queries: DataFrame, keys: list[str], query: str, tokens: str, corpus: DataFrame | None = None) -> DataFrame:
    """Rows with dense_score (cosine of hashed vectors) and vector; a stored corpus spares computing the rows twice."""
    vectors = hash_vectors((rows if corpus is None else corpus).select(*keys, F.col(tokens).alias("tokens")).distinct(), keys)
    name, = fresh(rows, "asked")
    asked = hash_vectors(queries.select(query, "tokens"), [query]).withColumnRenamed("vector", name)
    joined = rows.join(vectors, keys, "left").join(asked, query, "left")
    return joined.withColumn("dense_score", F.coalesce(cosine(F.col("vector"), F.col(name)), F.lit(0.0))).drop(name)


def ranked_results(queries: DataFrame, pages: DataFrame, options: Options, progress: Progress | None = None) -> DataFrame:
    """query_id, page_id, url, title, snippet and scores: the results kept for each query.

    BM25 over whole pages plays the backend; what it returns is filtered, ranked again by both scores of its title, url
    and snippet within the query, and cut to the results to keep.
    """
    results = pages_as_results(pages).filter("title <> '' AND url <> ''")
    listed = results.drop("html")
    corpus = results.select("result_id", F.col("result_id").alias("pos"), retrieval_tokens(page_words(F.col("html"))).alias("tokens"))
    found = bm25_top(corpus, queries, "result_id", "pos", "query_id", options.search_max_results)
    found = found.select("query_id", "result_id", F.col("rank").alias("backend_rank")).join(listed, "result_id").filter(is_http(F.col("url")))
    if options.blocked_domains:
        found = drop_blocked(found, blocked_list(pages.sparkSession, options.blocked_domains))
    found = found.withColumn("tokens", retrieval_tokens(search_document(F.col("title"), F.col("url"), F.col("text"))))
    scored = pool_scores(found, queries, "query_id").withColumn("pos", F.col("backend_rank"))
    ranked = hybrid_rank(scored, ["query_id"], "pos", options.search_dense_weight, options.search_rrf_cutoff, min(options.search_top_k, options.search_max_results_to_keep))
    ranked = ranked.select("query_id", F.col("result_id").alias("page_id"), "url", "title", F.col("text").alias("snippet"), "rank", "rrf_similarity", "dense_score", "bm25_score")
    progress = progress or Progress()
    return progress.stored(staged(progress.watch(ranked, "search_ranked", kept_results=F.count(F.lit(1))), "ranked"))
