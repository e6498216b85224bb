"""Reading known pages: one row per item, with focused chunks or the page's beginning, and related links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import retrieval_tokens, stripped
from ..operators.budget import within_budget
from ..operators.chunking import pack_chunks
from ..operators.pages import admissible_links, metadata, page_struct
from ..operators.pools import pool_scores
from ..operators.ranking import hybrid_rank, rank_by
from ..operators.urls import blocked_list, fetch_code
from ..sources.staging import staged
from .options import Options, checked_batch
from .research import with_fit


def read_items(items: DataFrame, pages: DataFrame, blocked: DataFrame | None = None, dns: DataFrame | None = None) -> DataFrame:
    """item_id, url, query, error_code, title, metadata, links, markdown of every item (item_id, url, query).

    Items without a page fail with fetch_failed, unsafe or blocked ones before that, empty ones with empty_content.
    Pages may have final_url, where a redirect ended, which must be as safe as the url; and fetch_error, why a page
    wasn't read: `timeout` gives fetch_timeout, any other fetch_failed.  Only pages that an item names are parsed.
    Items that name their page_id read that page, others the page of their url, the first one if a url has several.
    """
    more = [c for c in ("final_url", "fetch_error") if c in pages.columns]
    key = "page_id" if "page_id" in items.columns and "page_id" in pages.columns else "url"
    wanted = pages.join(items.select(key).distinct(), key, "left_semi")
    if key == "url":
        place, = fresh(wanted, "place")
        first = Window.partitionBy("url").orderBy(*(c for c in ("page_id", *more, "html") if c in pages.columns))
        wanted = wanted.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    wanted = wanted.select(key, *more, page_struct(F.col("html")).alias("p"))
    rows = fetch_code(items.select("item_id", "url", "query", *({key} - {"url"})), "code", "url", blocked, dns).join(wanted, key, "left")
    for name in ("final_url", "fetch_error"):
        if name not in more:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    if "final_url" in more:
        rows = fetch_code(rows, "final_code", "final_url", blocked, dns)
        rows = rows.withColumn("final_code", F.when(F.col("final_url").isNull(), "ok").otherwise(F.col("final_code")))
    else:
        rows = rows.withColumn("final_code", F.lit("ok"))
    error = F.when(F.col("code") != "ok", F.col("code")).when(F.col("final_code") != "ok", F.col("final_code")).when(F.col("fetch_error") == "timeout", "fetch_timeout")
    error = error.when(F.col("p").isNull() | F.col("fetch_error").isNotNull(), "fetch_failed").when(stripped(F.col("p.markdown")) == "", "empty_content")
    return staged(rows.select("item_id", "url", "query", error.alias("error_code"), F.col("p.title").alias("title"), F.struct(*metadata(F.col("p.meta"))).alias("metadata"), F.col("p.links").alias("links"), F.col("p.markdown").alias("markdown")), "items")


def is_focused(query):
    return query.isNotNull() & ~stripped(query).isin("", "*")


def page_order(rows: DataFrame, max_tokens: int) -> DataFrame:
    """item_id, chunk_id '1', text, tokens, truncated: the beginning of each page (character tokens)."""
    text = stripped(F.substring("markdown", 1, max_tokens)) if max_tokens > 0 else stripped(F.col("markdown"))
    return rows.select("item_id", F.lit("1").alias("chunk_id"), text.alias("text"), F.length(text).alias("tokens"), (F.length("markdown") > max_tokens if max_tokens > 0 else F.lit(False)).alias("truncated"))


def focused_chunks(rows: DataFrame, options: Options) -> DataFrame:
    """item_id, chunk_id, rank, text, tokens, truncated and scores: ranked chunks within the token budget.

    Chunks are those of the blocks that matter to the query, or of the whole page if none does.
    """
    fit = with_fit(rows.select("item_id", "query", "markdown"), retrieval_tokens(F.col("query")), options)
    text = F.when(stripped(F.coalesce("fit", F.lit(""))) != "", F.col("fit")).otherwise(F.col("markdown"))
    rows = staged(fit.select("item_id", "query", text.alias("markdown")), "fitted")
    chunks = pack_chunks(rows.select("item_id", "query", "markdown"), "markdown", options.crawl_max_chunk_tokens, options.crawl_overlap_tokens)
    chunks = chunks.withColumn("tokens_list", retrieval_tokens(F.col("chunk_text")))
    asked = rows.select("item_id", retrieval_tokens(F.col("query")).alias("tokens")).distinct()
    corpus = chunks.select("item_id", "chunk_id", "chunk_text", F.col("tokens").alias("size"), F.col("tokens_list").alias("tokens"))
    scored = pool_scores(corpus, asked, "item_id")
    ranked = hybrid_rank(scored.withColumn("pos", F.col("chunk_id")), ["item_id"], "pos", options.chunk_dense_weight, options.chunk_rrf_cutoff)
    ranked = ranked.select("item_id", "chunk_id", "rank", F.col("chunk_text").alias("text"), F.col("size").alias("tokens"), "rrf_similarity", "dense_score", "bm25_score")
    return within_budget(ranked, ["item_id"], "rank", options.scrape_max_tokens)


def prefiltered_links(links: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """Links (item_id, pos, url, text, context) with both scores; of more than `most` in an item, the best by BM25.

    Without query tokens or without link texts the first ones stay, as all scores are 0.
    """
    scored = pool_scores(links.withColumn("tokens", retrieval_tokens(F.concat_ws(" ", "text", "context"))), asked, "item_id")
    place, = fresh(scored, "place")
    return scored.withColumn(place, rank_by(["item_id"], "bm25_score", "pos")).filter(F.col(place) <= most).drop(place)


def related_links(rows: DataFrame, options: Options) -> DataFrame:
    """item_id, rank, url, text, score: next hops of each item, by relevance, or in page order without a query."""
    raw = rows.select("item_id", "url", "query", F.explode("links").alias("l")).select("item_id", "url", "query", "l.*")
    blocked = blocked_list(rows.sparkSession, options.blocked_domains) if options.blocked_domains else None
    links = staged(admissible_links(raw, "item_id", "url", blocked), "admissible")
    asked = rows.filter(is_focused(F.col("query"))).select("item_id", retrieval_tokens(F.col("query")).alias("tokens")).distinct()
    scored = prefiltered_links(links.join(asked.select("item_id"), "item_id", "left_semi"), asked, options.link_prefilter)
    best = hybrid_rank(scored, ["item_id"], "pos", options.search_dense_weight, 0.0, options.scrape_max_links)
    best = best.select("item_id", "rank", "url", "text", F.round("rrf_similarity", 4).alias("score"))
    plain = links.join(asked.select("item_id"), "item_id", "left_anti").withColumn("rank", rank_by(["item_id"], F.lit(0.0), "pos"))
    plain = plain.filter(F.col("rank") <= options.scrape_max_links).select("item_id", "rank", "url", "text", F.lit(None).cast("double").alias("score"))
    return best.unionByName(plain)


def batch_items(spark: SparkSession, items: list[dict]) -> DataFrame:
    """item_id, url, query of a checked batch of one to five items, in order."""
    rows = [(k, item["url"], item.get("query")) for k, item in enumerate(checked_batch(items))]
    return spark.createDataFrame(rows, "item_id int, url string, query string")


def scrape(items: DataFrame, pages: DataFrame, options: Options, dns: DataFrame | None = None) -> DataFrame:
    """One row per item: item_id, url, query, status, error_code, title, content_tokens, truncated, chunks, links."""
    blocked = blocked_list(items.sparkSession, options.blocked_domains) if options.blocked_domains else None
    rows = read_items(items, pages, blocked, dns)
    good = rows.filter("error_code IS NULL")
    chunks = focused_chunks(good.filter(is_focused(F.col("query"))), options)
    chunks = chunks.select("item_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "text", "tokens", "truncated", F.round("rrf_similarity", 4).alias("score"))
    whole = page_order(good.filter(~is_focused(F.col("query")) | F.col("query").isNull()), options.scrape_max_tokens).select("item_id", F.lit(1).alias("rank"), "chunk_id", "text", "tokens", "truncated", F.lit(None).cast("double").alias("score"))
    said = chunks.unionByName(whole).groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text", "tokens", "score"))).alias("chunks"), F.sum("tokens").alias("content_tokens"), F.bool_or("truncated").alias("truncated"))
    next_hops = related_links(good, options).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "text", "score"))).alias("links"))
    out = rows.drop("links").join(said, "item_id", "left").join(next_hops, "item_id", "left")
    return out.select("item_id", "url", "query", F.when(F.col("error_code").isNull(), "ok").otherwise("error").alias("status"), "error_code", "title", "metadata", F.coalesce("content_tokens", F.lit(0)).alias("content_tokens"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "chunks", "links")
