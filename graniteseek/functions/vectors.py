"""Dense vectors: cosine and a deterministic hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for lengths that differ, empty or null vectors and zero norms."""
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fine, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def hash_bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """The token's dimension: the first 8 hex digits of its MD5."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def hash_vectors(rows: DataFrame, keys: list[str], tokens: str = "tokens", dimensions: int = DIMENSIONS) -> DataFrame:
    """keys and `vector`: token counts by bucket, scaled to length 1.  Not semantic; a stand-in for a model.

    Rows without tokens are left out.  Counts combine on the map side.
    """
    counts = rows.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, hash_bucket(F.col("token"), dimensions).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    held = held.select(*keys, raw.alias("raw"))
    return held.select(*keys, F.transform("raw", lambda x: x / norm(F.col("raw"))).alias("vector"))
