"""Centroid clustering on integers: exact k-means rounds with block-norm screening.

A vector's components become integers, floor(scale * x).  For screening it is turned into a frame whose leading axes
span the centroids (right singular vectors), so the first `lead` coordinates tell most of what sets centroids apart.  The
others are compressed by segments to two numbers: the segment's mean, and the norm of what is left of it.  Two segments
whose rests have these norms are at least their difference apart (Cauchy-Schwarz), so the squared distance of two codes,

    sum over leading axes of (x - c)^2  +  sum over segments of size * (mean_x - mean_c)^2 + (|rest_x| - |rest_c|)^2,

is a lower bound of the distance of the vectors, for all centroids by one small matrix product.  A round takes the exact
integer distance to the centroid of least bound first and then only to centroids whose bound, less a margin for
rounding, isn't above the best so far.  The result is that of comparing all.  Codes are made before rounds 0, 1, 3, 7 ...:
a frame stays good as long as centroids move little, and they move less and less.  On random directions in 64 dimensions
2 to 5 of 8 exact distances are left; with segments alone, without a frame, none was spared.

Scale: vectors with their codes are written at each new frame; a round is a map over them that adds its sums up for each
task, so a few rows a task are shuffled; centroids (k * 64 integers) go to the tasks.  Sums are exact decimals, so the
order of adding doesn't matter and reruns agree.

Cases: rows whose vector is null, of another width, or with null or non-finite components are left out.  Repeated rows
and ids are rows of their own.  Rows with a null id take part but are never first centroids, as they have no hash; equal
hashes fall to the smaller vector.  Without any id the least vector is the only centroid.  Fewer vectors than centroids:
as many centroids as vectors.  Ties: smaller number.  Components beyond +-2^27 after scaling are held at that, and sums of
distances beyond a long at its largest, so that a squared distance fits.  Empty tables give no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free, sliced

WIDTH = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
LEAD = 8
SEGMENT = 4
SEED = "3"
MOST = 1 << 27
LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, width: int, scale: float, most: int = MOST) -> DataFrame:
    """id, x (array of int) of the vectors that can be clustered."""
    v = F.col("v")
    fine = (F.size(v) == width) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(-most)), F.lit(most)).cast("int")
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).filter(F.coalesce(fine, F.lit(False)))
    return rows.select("id", F.transform("v", held).alias("x"))


def grid_of(batch: pa.RecordBatch, name: str, width: int, kind=np.int64) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, width)


def frame_of(centres: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns; the leading ones span the centroids as well as so few can."""
    rows = np.linalg.svd(centres.astype(np.float64), full_matrices=True)[2]
    return rows.T


def codes_of(x: np.ndarray, frame: np.ndarray, lead: int, segment: int) -> np.ndarray:
    """Leading coordinates, means of segments times the root of their size, and norms of the rests."""
    turned = x.astype(np.float64) @ frame
    tail = turned[:, lead:]
    if not tail.shape[1]:
        return turned.astype(np.float32)
    starts = np.arange(0, tail.shape[1], segment)
    sizes = np.minimum(segment, tail.shape[1] - starts)
    mean = np.add.reduceat(tail, starts, axis=1) / sizes
    rest = tail - np.repeat(mean, sizes, axis=1)
    return np.hstack([turned[:, :lead], mean * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))]).astype(np.float32)


def bounds(code: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Lower bounds of all squared distances, less a margin that covers the rounding of codes."""
    a, b = code.astype(np.float64), centre.astype(np.float64)
    reach = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return reach - 2 * (a @ b.T) - 1e-6 * reach - 1


def nearest(x: np.ndarray, code: np.ndarray, centres: np.ndarray, centre_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, squared distance, and how many exact distances it took."""
    bound = bounds(code, centre_codes)
    every = np.arange(len(x))

    def exact(rows: np.ndarray, which) -> np.ndarray:
        gap = x[rows] - centres[which]
        return np.einsum("ij,ij->i", gap, gap)

    first = bound.argmin(1)
    best, least, tried = first.copy(), exact(every, first), np.ones(len(x), np.int64)
    for c in range(len(centres)):
        rows = np.flatnonzero((bound[:, c] <= least) & (first != c))
        if len(rows):
            d = exact(rows, c)
            tried[rows] += 1
            better = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
            best[rows[better]], least[rows[better]] = c, d[better]
    return best, least, tried


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> np.ndarray:
    rows = rows.filter("id is not null").select(F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")), 256).alias("h"), "x")
    found = rows.orderBy("h", "x").limit(clusters).collect()
    return np.array([r.x for r in found], np.int64)


@dataclass(frozen=True)
class Screen:
    """Centroids with the frame that vectors are coded in."""

    centres: np.ndarray
    frame: np.ndarray
    lead: int
    segment: int

    def nearest(self, batch: pa.RecordBatch):
        x = grid_of(batch, "x", self.centres.shape[1])
        code = grid_of(batch, "code", len(self.centre_codes[0]), np.float32)
        return x, *nearest(x, code, self.centres, self.centre_codes)

    @cached_property
    def centre_codes(self) -> np.ndarray:
        return codes_of(self.centres, self.frame, self.lead, self.segment)


def encode(rows: DataFrame, screen: Screen) -> DataFrame:
    """id, x and the code of a vector."""
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in sliced(batches, 8192):
            if batch.num_rows:
                codes = codes_of(grid_of(batch, "x", screen.centres.shape[1]), screen.frame, screen.lead, screen.segment)
                ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, codes.reshape(-1))], names=schema.names)

    return rows.mapInArrow(run, schema)


def assign(codes: DataFrame, screen: Screen) -> DataFrame:
    """id, cluster, distance, tried: exact distances that weren't screened out."""
    schema = T.StructType([codes.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("tried", T.LongType())])

    def run(batches):
        for batch in sliced(batches, 8192):
            if batch.num_rows:
                _, best, least, tried = screen.nearest(batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), pa.array(least, pa.int64()), pa.array(tried, pa.int64())], names=schema.names)

    return codes.mapInArrow(run, schema)


def moved(codes: DataFrame, screen: Screen) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of each non-empty one's vectors."""
    clusters, width = screen.centres.shape

    def run(batches):
        sums, counts = np.zeros((clusters, width), object), np.zeros(clusters, np.int64)
        for batch in sliced(batches, 8192):
            if batch.num_rows:
                x, best, _, _ = screen.nearest(batch)
                for c in np.unique(best).tolist():
                    rows = best == c
                    sums[c] += x[rows].sum(0).astype(object)  # 8192 * 2^27 fits a long
                    counts[c] += int(rows.sum())
        some = [c for c in range(clusters) if counts[c]]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(some, np.int32), width + 1)), pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(some))),
            pa.array([Decimal(int(v)) for c in some for v in (*sums[c], counts[c])], pa.decimal128(38))], names=["cluster", "at", "value"])

    # a task gives a row for each cluster and component at most; Spark adds them up as exact decimals
    parts = codes.select("x", "code").mapInArrow(run, "cluster int, at int, value decimal(38,0)").groupBy("cluster", "at").agg(F.sum("value").alias("value"))
    totals = {(r.cluster, r.at): int(r.value) for r in parts.collect()}
    out = screen.centres.copy()
    for c in {c for c, _ in totals}:
        out[c] = [totals[c, k] // totals[c, width] for k in range(width)]
    return out


def cluster_vectors(vectors: DataFrame, vec_id="vec_id", embedding="embedding", width=WIDTH, clusters=CLUSTERS, rounds=ROUNDS, scale=SCALE, lead=LEAD, segment=SEGMENT, seed=SEED) -> DataFrame:
    """One row per vector that can be clustered: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256,
    and n_exact, the exact distances its last assignment took."""
    schema = T.StructType([
        vectors.schema[vec_id], T.StructField("cluster", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")),
        T.StructField("centroid_sha256", T.StringType()), T.StructField("n_exact", T.LongType())])
    rows = integer_vectors(vectors, vec_id, embedding, width, scale)
    centres = first_centroids(rows, clusters, seed)
    if not len(centres):
        centres = np.array([r.x for r in rows.select("x").orderBy("x").limit(1).collect()], np.int64)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], schema)
    lead = min(lead, width)
    codes = screen = None
    for round_ in range(rounds):
        if round_ & (round_ + 1) == 0:
            screen = Screen(centres, frame_of(centres), lead, segment)
            codes, old = cut(encode(rows if codes is None else codes.select("id", "x"), screen), "centroid-codes"), codes
            free(old)
        found = moved(codes, screen)
        if np.array_equal(found, centres):  # so would all further rounds be
            break
        centres = found
        screen = replace(screen, centres=centres)
    if codes is None:
        screen = Screen(centres, frame_of(centres), lead, segment)
        codes = cut(encode(rows, screen), "centroid-codes")
    found = cut(assign(codes, screen), "centroid-clusters")
    free(codes)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    inertia = {r.cluster: min(LONG, int(r.s)) for r in sums}
    total = min(LONG, sum(int(r.s) for r in sums))
    facts = [(c, inertia.get(c, 0), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centres.tolist())]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    result = found.join(F.broadcast(facts), "cluster")  # a row a cluster
    return result.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("tried").alias("n_exact"))
