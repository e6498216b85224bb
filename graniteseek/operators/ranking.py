"""BM25, ranks, weighted reciprocal rank fusion and their composition.

Operators on pools take `pool` columns: statistics, ranks and cut-offs are those of a pool (a page's links, a query's
chunks), and windows are partitioned by it.

Operators on a whole corpus shuffle none of its text.  The best documents of many queries come from an inverted index
(see postings.py), whose rows also give the term statistics.  One query's scores of all documents are a Column
expression over statistics that add up on the map side to a row for each term.  Ranks over a whole corpus come from
range partitions and their offsets, not from one ordered window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import fresh
from ..functions.vectors import DIMENSIONS
from ..sources.staging import staged, unstaged
from .postings import B, K1, RANK_DECIMALS, index_statistics, search_index, stored_index
from .vector_index import QUERY_BLOCK, nearest_exact

EPSILON, RRF_K = 0.25, 60
#: Terms of queries that are broadcast at once, and counts by bucket that a task holds at once.
TERM_BLOCK = 200_000
SCORES = 4 << 20


def bm25_hits(corpus: DataFrame, queries: DataFrame, pool: list[str], key: list[str], query: list[str]) -> DataFrame:
    """pool, key, query, bm25_score of every document that shares a term with a query of its pool.

    corpus: pool, key, tokens; queries: pool, query, tokens.  Frequencies and the mean inverse document frequency
    are those of the whole pool, before query terms prune the token rows.
    """
    sized = corpus.withColumn("dl", F.size("tokens"))
    stats = sized.groupBy(*pool).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = corpus.select(*pool, F.explode(F.array_distinct("tokens")).alias("term")).groupBy(*pool, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(stats, pool).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = idf.groupBy(*pool).agg(F.avg("raw").alias("mean_idf"))
    asked = queries.select(*pool, *query, F.explode("tokens").alias("term")).groupBy(*pool, *query, "term").agg(F.count(F.lit(1)).alias("asked"))
    terms = asked.select(*pool, "term").distinct()
    weight = F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw"))
    idf = idf.join(terms, [*pool, "term"], "left_semi").join(means, pool).select(*pool, "term", "avgdl", weight.alias("idf"))
    tf = sized.select(*pool, *key, "dl", F.explode("tokens").alias("term")).join(terms, [*pool, "term"], "left_semi").groupBy(*pool, *key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    scored = tf.join(idf, [*pool, "term"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = scored.select(*pool, *key, "term", part.alias("part")).join(asked, [*pool, "term"])
    return hits.groupBy(*pool, *key, *query).agg(F.sum(F.col("part") * F.col("asked")).alias("bm25_score"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, pool: list[str], key: list[str]) -> DataFrame:
    """The corpus with bm25_score, where each pool has one query: documents without a hit score 0, none is lost."""
    hits = bm25_hits(corpus, queries, pool, key, [])
    return corpus.join(hits, [*pool, *key], "left").withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))


@dataclass
class Weights:
    """Query terms with the queries that have them."""

    terms: pa.Array
    term: np.ndarray  # of each pair of a query and a term
    query: np.ndarray  # of each pair, rising
    weights: np.ndarray  # inverse document frequency times places in the query
    names: list  # of the queries
    mean_length: float

    def by_query(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of each query."""
        first = np.searchsorted(self.query, np.arange(len(self.names) + 1))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield self.term[a:b], self.weights[a:b]


def term_statistics(corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """term, df, length: documents of each term; the null term has the number of documents and of all their tokens."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    terms = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), one.alias("n"), none.alias("size")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), one.alias("n"), F.size(tokens).cast("long").alias("size")))
    return corpus.select(F.inline(F.concat(terms, whole))).groupBy("term").agg(F.sum("n").alias("df"), F.sum("size").alias("length"))


def query_weights(stats: DataFrame, queries: DataFrame, query: str, term_block: int = TERM_BLOCK) -> Iterator[Weights]:
    """Weights of the queries (query, tokens) under stored term statistics, in blocks of bounded size.

    The mean inverse document frequency is that of all terms, not only those asked for.
    """
    whole = stats.filter("term IS NULL").first()
    asked = queries.select(F.col(query).alias("asked_by"), F.explode("tokens").alias("term")).groupBy("asked_by", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = staged(asked, "asked")
    blocks = max(1, -(-asked.count() // term_block))
    raw = F.log(F.lit(whole["df"] if whole else 0) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = stats.filter("term IS NOT NULL").select("term", raw.alias("raw"))
    mean = terms.agg(F.avg("raw")).first()[0] or 0.0
    weight = F.when(F.col("raw") < 0, F.lit(mean * EPSILON)).otherwise(F.col("raw"))
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("asked_by"), F.lit(blocks)) == block
        names = [r[0] for r in queries.select(F.col(query).alias("asked_by")).filter(mine).distinct().collect()]
        number = {name: k for k, name in enumerate(names)}
        rows = asked.filter(mine).join(terms, "term").select("term", "asked_by", (F.col("times") * weight).alias("weight")).collect()
        rows = sorted(rows, key=lambda r: (number[r["asked_by"]], r["term"]))
        found = sorted({r["term"] for r in rows})
        at = {t: k for k, t in enumerate(found)}
        length = whole["length"] / whole["df"] if whole and whole["length"] else 1.0
        yield Weights(pa.array(found, pa.string()), np.array([at[r["term"]] for r in rows], np.int64), np.array([number[r["asked_by"]] for r in rows], np.int64), np.array([r["weight"] for r in rows], float), names, length)
    unstaged(asked)


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _is(term: str):
    return lambda t: t == F.lit(term)


def bm25_column(corpus: DataFrame, queries: DataFrame, query: str, name: str = "bm25_score") -> DataFrame:
    """The corpus with the score of its one query; documents without a hit score 0.

    Only the query's own terms are kept of the tokens and counted, in a Column expression.
    """
    stats = staged(term_statistics(corpus), "term-statistics")
    weights, = query_weights(stats, queries, query)  # one query's terms are one block
    unstaged(stats)
    held, size = fresh(corpus, "held", "size")
    wanted = weights.terms.take(pa.array(weights.term)).to_pylist()
    rows = corpus.withColumns({held: F.filter("tokens", lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>"), size: F.size("tokens").cast("double")})
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B / weights.mean_length) * F.col(size))
    score = F.lit(0.0)
    for term, weight in zip(wanted, weights.weights.tolist()):
        tf = F.size(F.filter(held, _is(term))).cast("double")
        score = score + F.lit(weight * (K1 + 1)) * tf / (tf + norm)
    return rows.withColumn(name, F.coalesce(score, F.lit(0.0))).drop(held, size)


def hashed_dense_column(corpus: DataFrame, queries: DataFrame, name: str = "dense_score", dimensions: int = DIMENSIONS) -> DataFrame:
    """The corpus without its tokens, with the cosine of its hashed token counts and those of its one query; 0 if either
    has no tokens.  Tokens go to Python once and don't come back."""
    asked = queries.select("tokens").first()

    def buckets(tokens) -> np.ndarray:
        return np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dimensions for t in tokens], np.int64)

    wanted = np.bincount(buckets(asked[0] or ()) if asked else buckets(()), minlength=dimensions).astype(float)
    kept = [f for f in corpus.schema.fields if f.name != "tokens"]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def score(batches):
        for batch in _batches(batches, SCORES // dimensions):
            tokens = batch.column("tokens")
            doc = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            words = tokens.flatten().dictionary_encode()
            bucket = buckets(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            counts = np.bincount(doc * dimensions + bucket, minlength=len(tokens) * dimensions).reshape(len(tokens), dimensions).astype(float)
            size = np.sqrt((counts * counts).sum(1) * (wanted * wanted).sum())
            found = np.divide(counts @ wanted, size, out=np.zeros(len(tokens)), where=size > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.float64())], names=schema.names)

    return corpus.mapInArrow(score, schema)


def bm25_top(corpus: DataFrame, queries: DataFrame, key: str, pos: str, query: str, k: int, index: DataFrame | None = None) -> DataFrame:
    """query, key, pos, bm25_score, rank: the k best documents of one corpus for every query.

    corpus: key, pos (an integer), tokens; queries: query, tokens.  Documents that share no term score 0 and come by
    position.  index: the corpus's stored index, if there is one already.
    """
    found = bm25_shards(stored_index(corpus, key, pos) if index is None else index, queries, query, k).filter("best_pos IS NOT NULL").withColumnRenamed("key", key)
    ranked = found.withColumn("rank", rank_by([query], "bm25_score", "best_pos")).filter(F.col("rank") <= k)
    return ranked.select(query, key, *([] if pos == key else [F.col("best_pos").alias(pos)]), "bm25_score", "rank")


def bm25_shards(index: DataFrame, queries: DataFrame, query: str, k: int, term_block: int = TERM_BLOCK) -> DataFrame:
    """The best of each shard of an index, and how much was scored: see search_index."""
    stats, found = staged(index_statistics(index), "term-statistics"), None
    for weights in query_weights(stats, queries, query, term_block):
        part = search_index(index, weights, query, queries.schema[query].dataType, k)
        found = part if found is None else found.unionAll(part)
    unstaged(stats)
    return found


def global_rank(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their place, from 1, in one order over all of them.

    Rows go into range partitions, which are stored; a place is that within the partition plus the sizes of those
    before.  The order must tell all rows apart.
    """
    part, before = fresh(rows, "part", "before")
    placed = staged(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    # one row for each partition
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    sizes = sizes.withColumn(before, F.sum(before).over(Window.orderBy(part)) - F.col(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col(before)
    return placed.join(F.broadcast(sizes), part).withColumn(name, place.cast("int")).drop(part, before)


def rank_by(pool: list[str], score: str | Column, pos: str) -> Column:
    """1..n by score, highest first, ties in input order."""
    score = F.col(score) if isinstance(score, str) else score
    return F.row_number().over(Window.partitionBy(*pool).orderBy(F.round(score, RANK_DECIMALS).desc(), F.col(pos)))


def rrf(bm25_rank: Column, dense_rank: Column, dense_weight: float) -> Column:
    """Weighted reciprocal rank fusion."""
    check_weight(dense_weight)
    sparse = F.lit(1 - dense_weight) / (RRF_K + bm25_rank)
    return sparse + F.lit(dense_weight) / (RRF_K + dense_rank)


def check_weight(dense_weight: float) -> None:
    if not 0 < dense_weight <= 1:
        raise ValueError("dense_weight must be above 0 and at most 1")


def hybrid_rank(rows: DataFrame, pool: list[str], pos: str = "pos", dense_weight: float = 0.5, cutoff: float = 0.0, top_k: int | None = None) -> DataFrame:
    """Rows with bm25_score and dense_score, ranked within their pool; without pool columns all rows are one.

    Adds bm25_rank, dense_rank, rrf_score, rrf_similarity (0 to 1) and rank; keeps similarities of `cutoff` or
    more and the first `top_k`.  With dense_weight 1 the sparse rank is 1 throughout.
    """
    check_weight(dense_weight)

    def ranked(frame: DataFrame, name: str, *scores: str) -> DataFrame:
        order = [*(F.round(c, RANK_DECIMALS).desc() for c in scores), F.col(pos)]
        return frame.withColumn(name, F.row_number().over(Window.partitionBy(*pool).orderBy(*order))) if pool else global_rank(frame, name, *order)

    out = rows.withColumn("bm25_rank", F.lit(1)) if dense_weight == 1 else ranked(rows, "bm25_rank", "bm25_score")
    out = ranked(out, "dense_rank", "dense_score")
    out = out.withColumn("rrf_score", rrf(F.col("bm25_rank"), F.col("dense_rank"), dense_weight))
    out = out.withColumn("rrf_similarity", F.col("rrf_score") * (RRF_K + 1)).filter(F.col("rrf_similarity") >= cutoff - 1e-12)
    out = ranked(out, "rank", "rrf_score", "dense_score", "bm25_score")
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def cosine_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int) -> DataFrame:
    """query, key, dense_score, rank: the k nearest rows of every query vector, exactly: see vector_index."""
    return nearest_exact(vectors, queries, key, vector, query, query_vector, k, QUERY_BLOCK)
