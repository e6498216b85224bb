"""Pages as they arrive: canonical urls, first arrival wins, chunks, and ranking against standing queries.

Beyond the batch plans: each file that lands in a folder is a batch.  State holds one key per url and is bounded by
the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import retrieval_tokens
from ..functions.urls import canonical_url
from ..operators.ranking import bm25_top

PAGES = "page_id bigint, url string, html string"


def arriving_pages(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_arrivals(pages: DataFrame, within: str = "1 day") -> DataFrame:
    """Pages with canonical_url and arrived_at, each canonical url once within the watermark."""
    rows = pages.withColumns({"canonical_url": canonical_url(F.col("url")), "arrived_at": F.current_timestamp()})
    return rows.filter("canonical_url IS NOT NULL").withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["canonical_url"])


def rank_arrivals(pages: DataFrame, queries: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Ranks every batch's pages against the queries by BM25 over the batch and hands the best k to the sink."""
    def ranked(batch: DataFrame, number: int) -> None:
        plain = F.regexp_replace("html", r"(?s)<[^>]*>", " ")
        corpus = batch.select("page_id", F.col("page_id").alias("pos"), retrieval_tokens(plain).alias("tokens"))
        sink(bm25_top(corpus, queries, "page_id", "pos", "query_id", k), number)

    return pages.writeStream.foreachBatch(ranked).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
