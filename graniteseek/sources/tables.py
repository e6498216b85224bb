"""The driver's tables, read with column pruning and push-down left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, which are tens of MB of documents on both sides of a Python
    worker, several times over; a number that someone has set stays."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, rows)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, tokens: every benchmark question, asked with all its words."""
    tokens = retrieval_tokens(F.col("text"))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tokens, " ").alias("query"), tokens.alias("tokens"))
