"""Embedding whitening by LOBPCG, the locally optimal block preconditioned conjugate gradient method.

Components become integers x = floor(64 c) + 1000000.  The fit list holds each distinct vector once; n and the sums S
are exact.  The leading eigenvectors of the covariance are found without building it: an iteration multiplies the
covariance with a narrow block by one pass over the centred rows (each task adds up C^T (C B) for its rows C, Spark adds
the tasks' blocks), and Rayleigh-Ritz on the span of the iterate, the residual and the previous direction gives the next
iterate.  Products of the iterate and direction follow by linearity from those of the residual, so each iteration costs
one pass with a block as wide as the residual.  It ends when every wanted residual |V u - e u|, of a product taken
afresh, is at most `tolerance` of the largest eigenvalue, or fails loudly.  Some guard vectors beyond the wanted ones
make the convergence depend on the gap behind them; where the spans fill the whole space, one step is exact.

Each row is then projected and divided by the roots of the eigenvalues.  The covariance of the whitened fit list, by
one more pass, is compared with the identity.

Scale: distinct vectors are shuffled once by a 128-bit hash and written once; passes are maps whose results are
width * block doubles a task.  The driver holds blocks of width * 3 * block doubles, never rows.

Cases: rows whose vector is null or holds null or non-finite components give no row; nor do vectors of another width
than the commonest (ties: the longer).  Repeated rows and ids give rows each; a null id is an id.  Fewer dimensions than
components: as many components as dimensions.  A component without variance (rank below it; e <= 1e-12 of the largest,
or a single distinct vector) is whitened to 0 and left out of identity_error.  Integers are held at +-2^50, deviations
at the largest long, beyond which the exact value doesn't fit its type.  Empty tables give no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free, sliced

COMPONENTS = 16
GUARDS = 8
SCALE = 64
SHIFT = 1_000_000
MOST = 1 << 50
TOLERANCE = 1e-13
ITERATIONS = 200
NO_VARIANCE = 1e-12
LONG = (1 << 63) - 1


def shifted_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, x (array of long) of the vectors without null or non-finite components."""
    v = F.col("v")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: (F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(-MOST)), F.lit(MOST)) + F.lit(shift)).cast("long")
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).filter(F.coalesce(fine, F.lit(False)))
    return rows.select("id", F.transform("v", whole).alias("x"))


def _grid(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of S / n is taken off as an integer, so that no digits are lost."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s - int(w) * n) / n for s, w in zip(sums, whole)])
    return (x - whole[None, :]).astype(np.float64) - part[None, :]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; held at the largest long."""
    about = (centred(x, n, sums) * n) ** 2
    small = (about.sum(1) < 4e18) & (np.abs(x).max(1, initial=0) < LONG // (2 * max(1, n)))
    out = np.full(len(x), LONG, np.int64)
    if small.any():
        s = np.array([v if abs(v) <= LONG else 0 for v in sums], np.int64)
        gap = n * x[small] - s[None, :]
        out[small] = np.einsum("ij,ij->i", gap, gap)
    for k in np.flatnonzero(~small).tolist():
        out[k] = min(LONG, sum((n * v - s) ** 2 for v, s in zip(x[k].tolist(), sums)))
    return out


def _added(fit: DataFrame, width: int, columns: int, partial) -> np.ndarray:
    """The sum over tasks of `partial(batch rows)`, a matrix with `columns` columns."""
    def run(batches):
        total = None
        for batch in sliced(batches, 8192):
            if batch.num_rows:
                one = partial(_grid(batch, width))
                total = one if total is None else total + one
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["at", "value"])

    rows = fit.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r["at"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["at"]] = r["value"]
    return out.reshape(-1, columns)


def covariance_product(fit: DataFrame, n: int, sums: list[int], width: int):
    """block -> V block, by one pass over the fit list."""
    def product(block: np.ndarray) -> np.ndarray:
        def partial(x):
            c = centred(x, n, sums)
            return c.T @ (c @ block)

        return _added(fit, width, block.shape[1], partial) / n

    return product


def _beside(block: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the block beside the orthonormal others; as many as there is room for."""
    room = min(block.shape[1], len(block) - others.shape[1])
    for _ in range(3):
        block = block - others @ (others.T @ block)
        block = np.linalg.qr(block)[0][:, :room]
    return block


def lobpcg(product, width: int, wanted: int, guards: int = GUARDS, tolerance: float = TOLERANCE, iterations: int = ITERATIONS, trace: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues, falling, their unit eigenvectors as columns, and the passes it took.

    product: block -> V block, for a symmetric V without negative eigenvalues.
    """
    block = min(width, wanted + guards)
    x, _ = np.linalg.qr(np.random.default_rng(13).standard_normal((width, block)))
    ax, passes = product(x), 1
    p = ap = np.zeros((width, 0))
    fresh, best, stalls = True, np.inf, 0
    for _ in range(iterations):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        order = np.argsort(values)[::-1]
        values, x, ax = values[order], x @ turn[:, order], ax @ turn[:, order]
        r = ax - x * values
        worst = np.sqrt((r * r).sum(0))[:wanted].max(initial=0.0)
        if worst <= tolerance * max(values[0], 0.0):
            if fresh:
                return values[:wanted], x[:, :wanted], passes
            ax, fresh, passes = product(x), True, passes + 1  # certify: the product itself, not one carried along
            continue
        stalls = stalls + 1 if fresh and worst > best / 2 else 0
        best = min(best, worst)
        if stalls > 8 and worst <= 100 * tolerance * values[0]:
            return values[:wanted], x[:, :wanted], passes  # as near as doubles come
        w = _beside(r, np.hstack([x, p]))
        aw = product(w) if w.shape[1] else w
        passes += bool(w.shape[1])
        # an orthonormal basis, so all that follows is combined from it with orthonormal coefficients, products alike
        s, a = np.hstack([x, w, p]), np.hstack([ax, aw, ap])
        values, turn = np.linalg.eigh((s.T @ a + a.T @ s) / 2)
        turn = turn[:, np.argsort(values)[::-1][:block]]
        aside = turn.copy()
        aside[:block] = 0  # the direction: what of the new iterate isn't in the old one
        aside = _beside(aside, turn)
        x, ax, p, ap, fresh = s @ turn, a @ turn, s @ aside, a @ aside, False
        if worst <= 1e3 * tolerance * values.max():
            ax, fresh, passes = product(x), True, passes + 1
    raise ValueError(f"LOBPCG hasn't come to a residual of {tolerance} in {iterations} iterations (last: {worst / max(values.max(), 1e-300)})")


def _fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once."""
    keyed = rows.select("x", F.xxhash64(F.lit(1), "x").alias("hi"), F.xxhash64(F.lit(2), "x").alias("lo"))
    return keyed.groupBy("hi", "lo").agg(F.first("x").alias("x")).select("x")


def whiten(vectors: DataFrame, vec_id="vec_id", embedding="embedding", components=COMPONENTS, guards=GUARDS, scale=SCALE, shift=SHIFT, tolerance=TOLERANCE) -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = T.StructType([
        vectors.schema[vec_id], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    rows = shifted_vectors(vectors, vec_id, embedding, scale, shift)
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = common["width"]
    rows = rows.filter(F.size("x") == width)
    fit = cut(_fit_list(rows), "whitening-fit")
    facts = fit.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[k].cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(width))).first()
    n, sums = facts["n"], [int(facts[f"s{k}"]) for k in range(width)]

    def spread(x):
        c = centred(x, n, sums)
        return np.array([[float((c * c).sum())]])

    trace = float(_added(fit, width, 1, spread)[0, 0]) / n
    wanted = min(components, width)
    if trace > 0:
        values, units, _ = lobpcg(covariance_product(fit, n, sums, width), width, wanted, guards, tolerance)
    else:
        values, units = np.zeros(wanted), np.eye(width)[:, :wanted]
    real = values > NO_VARIANCE * max(values.max(initial=0.0), 0.0)
    turn = np.where(real, units / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = np.where(real, values / trace if trace > 0 else 0.0, 0.0)

    def moments(x):
        y = centred(x, n, sums) @ turn
        return np.vstack([y.T @ y, y.sum(0)[None, :]])

    total = _added(fit, width, wanted, moments) / n
    whitened_covariance = total[:-1] - np.outer(total[-1], total[-1])
    error = float(np.abs((whitened_covariance - np.eye(wanted))[np.ix_(real, real)]).max(initial=0.0))
    free(fit)

    def project(batches):
        for batch in sliced(batches, 4096):
            if batch.num_rows:
                x = _grid(batch, width)
                y = centred(x, n, sums) @ turn
                rows_, k = len(x), wanted
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(np.arange(rows_), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)),
                    pa.array(np.full(rows_ * k, n, np.int64)), pa.array(np.repeat(deviations(x, n, sums), k)), pa.array(y.reshape(-1)),
                    pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, error))], names=schema.names)

    return rows.mapInArrow(project, schema)
