"""Nearest vectors by cosine: exactly by blocks of matrix products, or by inverted lists with product-quantised residuals.

The index is trained on a bounded sample (`sample_rows` vectors, those whose key hashes lowest): coarse centroids by
k-means on unit vectors, then for each of `parts` slices of the residual (vector less centroid) a codebook of at most 256
words.  Every vector is coded by a map as the number of its list and one byte a slice, and stored in order of lists, so a
search reads the files of the lists it probes.

A query probes the lists whose centroids are nearest.  As <q, x> = <q, centroid> + the sum over slices of <q, word>, one
table of slices by words serves a query in all lists (asymmetric distances: the query itself isn't coded).  A task keeps
the best `candidates` of each query from the lists it reads; these meet their vectors in an equi-join and are ranked by
their exact cosine.  Nothing is a nested loop, and no list is ever one task: lists are stored in files of any number.

How many lists are probed and candidates kept is measured, not guessed: on a part of the sample that was kept from
training, the smallest numbers whose recall against exact search reaches `recall`.  Among random directions, where
neighbours lie in most lists, that means to probe most of them; clustered vectors need a few.

Cases: vectors that are null, empty, zero, of another width than the commonest or with null or non-finite components are
in no list and are never found; such queries find nothing.  Fewer than k vectors give fewer rows.  Repeated keys are
rows of their own: candidates are told apart by a number of the row.  Ties fall to the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine
from ..sources.staging import staged

RANK_DECIMALS = 9
#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4096


@dataclass(frozen=True)
class VectorOptions:
    sample_rows: int = 20_000
    lists: int = 0  # 0: the root of the number of vectors, at most `most_lists`
    most_lists: int = 4096
    parts: int = 16
    words: int = 256
    rounds: int = 12
    probes_kept_back: int = 200
    recall: float = 0.97
    measured_at: int = 10


def usable(v: Column, width: int | None = None) -> Column:
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine if width is None else fine & (F.size(v) == width), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _grid(column: pa.Array, width: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from a random choice; an empty centroid moves to the vector farthest from its own."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, gap = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        empty = np.flatnonzero(~full)
        centres[empty] = x[np.argsort(-gap)[: len(empty)]]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, gap = np.empty(len(x), np.int64), np.empty(len(x))
    square = (centres * centres).sum(1)
    for at in range(0, len(x), 4096):
        some = x[at : at + 4096]
        d = square[None, :] - 2 * some @ centres.T
        near[at : at + 4096] = d.argmin(1)
        gap[at : at + 4096] = d.min(1) + (some * some).sum(1)
    return near, gap


@dataclass
class Codec:
    """Coarse centroids and codebooks."""

    centres: np.ndarray
    books: list[np.ndarray]
    edges: np.ndarray  # of the slices

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, _ = _nearest(x, self.centres)
        rest = x - self.centres[near]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for j, book in enumerate(self.books):
            codes[:, j] = _nearest(rest[:, self.edges[j] : self.edges[j + 1]], book)[0]
        return near, codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries by slices by words."""
        out = np.zeros((len(queries), len(self.books), max(len(b) for b in self.books)))
        for j, book in enumerate(self.books):
            out[:, j, : len(book)] = queries[:, self.edges[j] : self.edges[j + 1]] @ book.T
        return out

    def estimates(self, queries: np.ndarray, tables: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """queries by vectors: the inner products that the codes stand for."""
        out = (queries @ self.centres.T)[:, lists]
        for j in range(len(self.books)):
            out += tables[:, j][:, codes[:, j]]
        return out


def train(sample: np.ndarray, lists: int, options: VectorOptions) -> Codec:
    rng = np.random.default_rng(17)
    centres = kmeans(sample, lists, options.rounds, rng)
    rest = sample - centres[_nearest(sample, centres)[0]]
    edges = np.linspace(0, sample.shape[1], min(options.parts, sample.shape[1]) + 1).astype(int)
    return Codec(centres, [kmeans(rest[:, a:b], options.words, options.rounds, rng) for a, b in zip(edges[:-1], edges[1:])], edges)


def calibrate(codec: Codec, base: np.ndarray, queries: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Lists to probe, and candidates for each result wanted, whose recall on these queries is `recall` or more."""
    k = min(k, len(base))
    if not k or not len(queries):
        return len(codec.centres), 8.0
    exact = queries @ base.T
    true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    lists, codes = codec.encode(base)
    order = np.argsort(-(queries @ codec.centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list among a query's
    estimate = codec.estimates(queries, codec.tables(queries), lists, codes)
    within = place[:, lists]
    at = np.take_along_axis(within, true, 1)
    tries = sorted({min(len(codec.centres), max(1, round(len(codec.centres) * s))) for s in (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)})
    probes = next((p for p in tries if (at < p).mean() >= (1 + recall) / 2), tries[-1])
    estimate = np.where(within < probes, estimate, -np.inf)
    better = np.sort((estimate[:, None, :] > np.take_along_axis(estimate, true, 1)[:, :, None]).sum(2).reshape(-1))
    needed = better[min(len(better) - 1, int(np.ceil((1 + recall) / 2 * len(better))))] + 1
    return probes, max(2.0, 1.5 * needed / k)


@dataclass
class VectorIndex:
    codes: DataFrame  # list, row, key, code
    vectors: DataFrame  # row, vector
    codec: Codec
    width: int
    probes: int
    oversample: float
    key: str
    options: VectorOptions = field(default_factory=VectorOptions)


def build_vector_index(vectors: DataFrame, key: str, vector: str, options: VectorOptions = VectorOptions()) -> VectorIndex | None:
    """Trains on a bounded sample and codes every vector; None if there is none that can be found."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return None
    width, total = width["width"], width["count"]
    rows = staged(rows.filter(F.size("vector") == width).withColumn("row", F.monotonically_increasing_id()), "vectors")
    place = F.xxhash64(F.col("key").cast("string"), F.lit(5))
    sample = [r.vector for r in rows.orderBy(place, "row").limit(options.sample_rows).select("vector").collect()]
    sample = _unit(np.array(sample, np.float64))
    lists = options.lists or min(options.most_lists, max(1, int(np.sqrt(total))))
    back = min(options.probes_kept_back, len(sample) // 5)
    codec = train(sample[back:], lists, options)
    probes, oversample = calibrate(codec, sample[back:], sample[:back], options.measured_at, options.recall)
    key_type = rows.schema["key"]
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("row", T.LongType()), key_type, T.StructField("code", T.BinaryType())])
    shipped = rows.sparkSession.sparkContext.broadcast(codec)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                near, codes = shipped.value.encode(_grid(batch.column("vector"), width))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("row"), batch.column("key"), pa.array([c.tobytes() for c in codes], pa.binary())], names=schema.names)

    coded = rows.select("key", "vector", "row").mapInArrow(encode, schema)
    # ranges, not hashes, of (list, row): a list of a third of all vectors is cut into many files
    codes = staged(coded.repartitionByRange("list", "row").sortWithinPartitions("list"), "vector-codes")
    return VectorIndex(codes, rows.select("row", "vector"), codec, width, probes, oversample, key, options)


def search_vectors(index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int, probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """query, key, dense_score, rank: about the k nearest rows of every query vector, ranked by their exact cosine."""
    probes = min(probes or index.probes, len(index.codec.centres))
    candidates = candidates or max(k, int(np.ceil(k * index.oversample)))
    spark, codec, width = index.codes.sparkSession, index.codec, index.width
    asked = queries.select(F.col(query).alias("q"), F.col(vector).alias("u")).filter(usable(F.col("u"), width))
    asked = staged(asked.withColumn("number", F.monotonically_increasing_id()), "asked-vectors")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("row", T.LongType()), T.StructField("key", index.codes.schema["key"].dataType), T.StructField("estimate", T.DoubleType())])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    found = None
    for block in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("number", "u").collect()
        if not held:
            continue
        u = _unit(np.array([r.u for r in held], np.float64))
        near = np.argsort(-(u @ codec.centres.T), axis=1)[:, :probes]
        by_list: dict[int, list[int]] = {}
        for q, some in enumerate(near.tolist()):
            for c in some:
                by_list.setdefault(c, []).append(q)
        shipped = spark.sparkContext.broadcast((u, codec.tables(u), {c: np.array(v) for c, v in by_list.items()}, np.array([r.number for r in held]), codec))

        def scan(batches, shipped=shipped):
            u, tables, by_list, numbers, codec = shipped.value
            best = _Best(len(numbers), candidates)
            for batch in batches:
                lists = batch.column("list").to_numpy()
                cuts = np.flatnonzero(np.diff(lists, prepend=-1, append=-1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    qs = by_list.get(int(lists[a]))
                    for at in range(a, b, 8192) if qs is not None else ():
                        part = batch.slice(at, min(8192, b - at))
                        codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                        for q in range(0, len(qs), 256):
                            some = qs[q : q + 256]
                            best.take(some, codec.estimates(u[some], tables[some], lists[at : at + part.num_rows], codes), part)
            yield best.batch(numbers, arrow, schema.names)

        part = index.codes.filter(F.col("list").isin(sorted(by_list))) if len(by_list) < len(codec.centres) else index.codes
        part = part.mapInArrow(scan, schema)
        first = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("estimate"), "key", "row"))
        kept = part.withColumn("place", first).filter(F.col("place") <= candidates).select("number", "row", "key")
        # at most QUERY_BLOCK * candidates rows go to the vectors, which stay where they are
        exact = index.vectors.join(F.broadcast(kept), "row")
        found = exact if found is None else found.unionAll(exact)
    if found is None:
        return _nothing(queries, query, index)
    exact = found.join(asked, "number").select("number", "row", F.col("q").alias(query), F.col("key").alias(index.key), cosine(F.col("vector"), F.col("u")).alias("dense_score"))
    return _ranked(exact, "number", index.key, k).select(query, index.key, "dense_score", "rank")


def _nothing(queries: DataFrame, query: str, index: VectorIndex) -> DataFrame:
    schema = T.StructType([queries.schema[query], T.StructField(index.key, index.codes.schema["key"].dataType), T.StructField("dense_score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return queries.sparkSession.createDataFrame([], schema)


def _ranked(rows: DataFrame, query: str, key: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.round("dense_score", RANK_DECIMALS).desc(), F.col(key), "row"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


class _Best:
    """The best rows so far of each query: by score, highest first, then by key."""

    def __init__(self, queries: int, most: int):
        self.most, self.held = most, [[] for _ in range(queries)]
        self.bar = np.full(queries, -np.inf)

    def take(self, queries: np.ndarray, scores: np.ndarray, batch: pa.RecordBatch) -> None:
        rows, keys = batch.column("row"), batch.column("key")
        place = np.argsort(pc.sort_indices(keys, null_placement="at_start").to_numpy(), kind="stable")
        for q, column in zip(queries.tolist(), scores):
            new = np.flatnonzero(column >= self.bar[q])
            if not len(new):
                continue
            if len(new) > self.most:
                least = np.partition(column[new], -self.most)[-self.most]
                new = new[column[new] >= least]
                new = new[np.lexsort((place[new], -column[new]))[: self.most]]
            own = [(-float(column[j]), keys[j].is_valid, keys[j].as_py(), rows[j].as_py()) for j in new.tolist()]
            self.held[q] = sorted(self.held[q] + own)[: self.most]
            if len(self.held[q]) == self.most:
                self.bar[q] = -self.held[q][-1][0]

    def batch(self, numbers: np.ndarray, arrow: list, names: list[str]) -> pa.RecordBatch:
        rows = [(int(n), row, key, -score) for n, held in zip(numbers, self.held) for score, _, key, row in held]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=names)


def nearest_exact(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query, key, dense_score, rank: the k nearest rows of every query vector, by all cosines.

    A stated set of queries goes in broadcast blocks of bounded size to batches of all rows, as matrix products; a task
    hands on k rows a query.  Vectors without a direction, and those of another width than the query's, score 0.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.when(usable(F.col(vector)), F.col(vector)).alias("v"), F.monotonically_increasing_id().alias("row"))
    asked = staged(queries.select(F.col(query).alias("q"), F.when(usable(F.col(query_vector)), F.col(query_vector)).alias("u"), F.monotonically_increasing_id().alias("number")), "asked-vectors")
    blocks = max(1, -(-asked.count() // query_block))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("row", T.LongType()), T.StructField("key", vectors.schema[key].dataType), T.StructField("dense_score", T.DoubleType())])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    found = None
    for block in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("number", "u").collect()
        shipped = spark.sparkContext.broadcast(([r.number for r in held], [r.u for r in held]))

        def scan(batches, shipped=shipped):
            numbers, us = shipped.value
            widths = np.array([len(u) if u is not None else 0 for u in us], np.int64)
            grids = {w: (np.flatnonzero(widths == w), _unit(np.array([us[q] for q in np.flatnonzero(widths == w)], np.float64))) for w in set(widths.tolist()) - {0}}
            best = _Best(len(numbers), k)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    own = part.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    for q in range(0, len(numbers), 1024):
                        some = np.arange(q, min(len(numbers), q + 1024))
                        scores = np.zeros((len(some), part.num_rows))
                        for w, (which, grid) in grids.items():
                            mine, there = np.flatnonzero((which >= q) & (which < q + 1024)), np.flatnonzero(own == w)
                            if len(mine) and len(there):
                                scores[np.ix_(which[mine] - q, there)] = grid[mine] @ _grid(part.column("v").take(pa.array(there)), w).T
                        best.take(some, np.round(scores, RANK_DECIMALS), part)
            yield best.batch(np.array(numbers, np.int64), arrow, schema.names)

        part = rows.select("row", "key", "v").mapInArrow(scan, schema)
        found = part if found is None else found.unionAll(part)
    return _ranked(found.join(asked.select("number", F.col("q").alias(query)), "number").withColumnRenamed("key", key), "number", key, k).select(query, key, "dense_score", "rank")
