"""From queries to evidence: discover, read, chunk, rank, select, all as one plan keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens, stripped
from ..operators.chunking import pack_chunks, pruned
from ..operators.dedupe import select_with_quota
from ..operators.pages import page_struct
from ..operators.pools import pool_scores, with_fit_blocks
from ..operators.ranking import bm25_top, hybrid_rank
from ..sources.staging import staged
from .options import Options
from .progress import Progress
from .search import ranked_results


def with_fit(rows: DataFrame, asked: Column, options: Options) -> DataFrame:
    """Rows with fit: the blocks of their markdown that matter to the tokens asked, by the configured filter; null without
    one or if none does."""
    if options.crawl_fit_markdown_mode == "bm25":
        return with_fit_blocks(rows, asked, options.crawl_bm25_threshold)
    if options.crawl_fit_markdown_mode == "pruning":
        return rows.withColumn("fit", pruned(F.col("markdown"), options.crawl_pruning_threshold))
    return rows.withColumn("fit", F.lit(None).cast("string"))


def readable(kept: DataFrame, pages: DataFrame, queries: DataFrame, options: Options) -> DataFrame:
    """query_id, page_id, url, title, rank, markdown: each kept page parsed once, whoever keeps it."""
    wanted = pages.join(kept.select("page_id").distinct(), "page_id", "left_semi").select("page_id", page_struct(F.col("html"))["markdown"].alias("markdown"))
    asked = queries.select("query_id", F.col("tokens").alias("asked"))
    rows = with_fit(kept.join(wanted, "page_id").join(asked, "query_id", "left"), F.col("asked"), options).drop("asked")
    enough = F.length(stripped(F.coalesce("fit", F.lit("")))) >= options.crawl_fit_min_chars
    rows = rows.withColumn("markdown", F.when(enough, F.col("fit")).otherwise(F.col("markdown"))).drop("fit")
    if options.crawl_max_page_tokens > 0:
        rows = rows.withColumn("markdown", F.substring("markdown", 1, options.crawl_max_page_tokens))
    return rows


def chunk_pool(rows: DataFrame, queries: DataFrame, options: Options) -> DataFrame:
    """The best chunks of each query over all its pages: as many as selection may need."""
    chunks = pack_chunks(rows.select("query_id", "page_id", "url", "title", F.col("rank").alias("result_rank"), "markdown"), "markdown", options.crawl_max_chunk_tokens, options.crawl_overlap_tokens)
    corpus = chunks.withColumns({"size": F.col("tokens"), "tokens": retrieval_tokens(F.col("chunk_text")), "pos": F.struct("result_rank", "chunk_id")})
    scored = pool_scores(corpus, queries, "query_id")
    cap = max(1, options.chunk_max_results_to_keep * options.chunk_rank_oversample)
    ranked = hybrid_rank(scored, ["query_id"], "pos", options.chunk_dense_weight, options.chunk_rrf_cutoff, cap)
    name = F.concat_ws(":", F.col("page_id"), F.col("chunk_id"))
    return ranked.select("query_id", name.alias("chunk_id"), F.col("url").alias("source_url"), "title", "heading", F.col("chunk_text").alias("text"), F.col("size").alias("tokens"), "rank", "rrf_similarity", "dense_score", "bm25_score", "vector")


def research(queries: DataFrame, pages: DataFrame, options: Options = Options(), kept: DataFrame | None = None, progress: Progress | None = None) -> DataFrame:
    """One row per ranked chunk of a query, with its fate: query_id, chunk_id, source_url, text, scores, status, selected.

    kept: the results of `ranked_results`, if they are known already.  progress: hears of each stage.
    """
    progress = progress or Progress()
    kept = ranked_results(queries, pages, options, progress) if kept is None else kept
    read = progress.watch(readable(kept, pages, queries, options), "pages_read", urls_read=F.count(F.lit(1)))
    pool = progress.watch(chunk_pool(read, queries, options), "chunks_ranked", chunks_considered=F.count(F.lit(1)))
    decided = select_with_quota(pool, "query_id", options.chunk_max_results_to_keep, options.chunk_max_per_source_url, options.chunk_dedupe_jaccard_threshold, options.chunk_semantic_dedupe_threshold, options.chunk_semantic_dedupe_enabled)
    decided = progress.watch(decided, "chunks_selected", chunks_selected=F.count_if(F.col("status") == "accepted"))
    return progress.stored(staged(decided, "decided"))


def evidence(decided: DataFrame) -> DataFrame:
    """query_id, sources: accepted chunks by source, both in order of rank."""
    accepted = decided.filter("status = 'accepted'")
    by_source = accepted.groupBy("query_id", "source_url", "title").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text", "tokens", "rrf_similarity", "dense_score", "bm25_score"))).alias("chunks"))
    return by_source.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_url", "title", "chunks"))).alias("sources"))


def run_stats(queries: DataFrame, results: DataFrame, decided: DataFrame) -> DataFrame:
    """query_id, status, search_results, chunks_considered, chunks_selected."""
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("search_results"))
    chunks = decided.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_considered"), F.count_if(F.col("status") == "accepted").alias("chunks_selected"))
    out = queries.select("query_id").join(found, "query_id", "left").join(chunks, "query_id", "left")
    return out.select("query_id", F.when(F.col("search_results").isNull(), "no_results").otherwise("ok").alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("search_results", "chunks_considered", "chunks_selected")))


def token_savings(queries: DataFrame, results: DataFrame, pages: DataFrame, decided: DataFrame) -> DataFrame:
    """query_id, naive_tokens (snippets and the readable text of whole pages), returned_tokens, tokens_saved, pct_saved,
    in the character tokens that chunks are counted in."""
    wanted = pages.join(results.select("page_id").distinct(), "page_id", "left_semi")
    naive = results.join(wanted.select("page_id", F.length(page_struct(F.col("html"))["markdown"]).alias("page_tokens")), "page_id").groupBy("query_id").agg(F.sum(F.length("snippet") + F.col("page_tokens")).alias("naive_tokens"))
    back = decided.filter("status = 'accepted'").groupBy("query_id").agg(F.sum("tokens").alias("returned_tokens"))
    out = queries.select("query_id").join(naive, "query_id", "left").join(back, "query_id", "left").na.fill(0, ["naive_tokens", "returned_tokens"])
    saved = F.col("naive_tokens") - F.col("returned_tokens")
    return out.select("query_id", "naive_tokens", "returned_tokens", saved.alias("tokens_saved"), F.when(F.col("naive_tokens") > 0, F.round(100 * saved / F.col("naive_tokens"), 1)).otherwise(0.0).alias("pct_saved"))


def savings_total(savings: DataFrame) -> DataFrame:
    """One row over all queries: naive_tokens, returned_tokens, tokens_saved, pct_saved."""
    sums = savings.agg(*(F.sum(c).alias(c) for c in ("naive_tokens", "returned_tokens", "tokens_saved")))
    return sums.withColumn("pct_saved", F.when(F.col("naive_tokens") > 0, F.round(100 * F.col("tokens_saved") / F.col("naive_tokens"), 1)).otherwise(0.0))


def local_search(rows: DataFrame, queries: DataFrame, text: str, key: str, top_k: int = 5, options: Options = Options()) -> DataFrame:
    """query_id, chunk_id ("key:chunk"), rank, bm25_score, chunk_text: the best chunks of all rows for each query.

    rows: key (an integer), text.  Chunks are packed on the way and only the best ones' texts move.
    """
    chunks = pack_chunks(rows.select(key, text), text, options.crawl_max_chunk_tokens, options.crawl_overlap_tokens)
    chunks = staged(chunks.select(F.col(key).cast("long").alias("row"), F.col("chunk_id").alias("n"), "chunk_text"), "local-chunks")
    # places in the order of rows and chunks; a key too large for that is an error, not a wrong place
    most = (chunks.agg(F.max("n")).first()[0] or 0) + 1
    chunks = chunks.select((F.col("row") * F.lit(most).cast("long") + F.col("n")).alias("pos"), F.concat_ws(":", "row", "n").alias("chunk_id"), "chunk_text")
    best = bm25_top(chunks.select("pos", retrieval_tokens(F.col("chunk_text")).alias("tokens")), queries, "pos", "pos", "query_id", top_k)
    return best.join(chunks, "pos").select("query_id", "chunk_id", "rank", "bm25_score", "chunk_text")
