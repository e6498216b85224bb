import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteseek.llm.whitening import LONG, centred, deviations, lobpcg, whiten

from .test_centroids import VECTORS


def brute(rows, components=16):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, units = np.linalg.eigh(c.T @ c / n)
    values, units = values[::-1][:components], units[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        gap = [n * a - s for a, s in zip(x, sums)]
        out[i] = (n, sum(g * g for g in gap), np.array(gap) / n @ units / np.sqrt(values))
    return out, values / np.trace(c.T @ c / n)


def by_row(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize("scales", [np.ones(64), np.linspace(3, 0.3, 64), 0.8 ** np.arange(40)])
def test_equals_the_definition(spark, scales):
    rng = np.random.default_rng(8)
    rows = [(k, (scales * rng.standard_normal(len(scales))).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(50)]  # copies don't weigh in the fit
    found = by_row(whiten(spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)))
    want, explained = brute(rows)
    assert set(found) == set(want)
    grid = np.array([[found[i][c].whitened for c in range(1, 17)] for i in want])
    true = np.array([want[i][2] for i in want])
    sign = np.sign((grid * true).sum(0))
    assert np.abs(grid * sign - true).max() < 1e-8
    for i, (n, deviation, _) in want.items():
        assert {(r.n, r.deviation) for r in found[i].values()} == {(n, deviation)}
        assert np.allclose([found[i][c].explained for c in range(1, 17)], explained, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in found[i].values())


def test_lobpcg_in_a_wide_space_takes_few_narrow_passes():
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    values = 0.9 ** np.arange(400)
    v = (q * values) @ q.T
    widths = []

    def product(block):
        widths.append(block.shape[1])
        return v @ block

    got, units, passes = lobpcg(product, 400, 16)
    assert np.allclose(got, values[:16], rtol=1e-12)
    assert np.abs(np.abs((units * q[:, :16]).sum(0)) - 1).max() < 1e-10
    assert passes == len(widths) < 100 and max(widths) <= 24
    assert np.linalg.norm(v @ units - units * got, axis=0).max() <= 1e-13


def test_lobpcg_fails_loudly():
    v = np.diag(1 - 1e-9 * np.arange(300))
    with pytest.raises(ValueError, match="residual"):
        lobpcg(lambda b: v @ b + 1e-3 * np.random.default_rng(b.shape[1]).standard_normal(b.shape), 300, 4, iterations=5)


def test_odd_rows(spark):
    rng = np.random.default_rng(10)
    good = [rng.standard_normal(5).tolist() for _ in range(8)]
    rows = [(k, v, None) for k, v in enumerate(good)] + [(None, good[0], None), (1, good[1], None), (50, None, None), (51, [], None), (52, [1.0], None), (53, [float("nan")] * 5, None), (54, [float("-inf")] + [0.0] * 4, None), (55, [None] * 5, None)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(7) for c in ("x", "id", "component", "n", "hi", "lo", "at")})
    found = whiten(frame).collect()
    assert len(found) == 10 * 5 and {r.component for r in found} == {1, 2, 3, 4, 5} and {r.n for r in found} == {8}
    assert whiten(frame.limit(0)).count() == 0 and whiten(frame.filter("vec_id in (50, 51, 53)")).count() == 0
    one = whiten(frame.filter("vec_id = 1")).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(0.0, 0.0, 0.0, 0)}
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], None) for k in range(4)], VECTORS)  # rank 1
    for r in whiten(flat).collect():
        assert (r.whitened == 0.0) == (r.component > 1) and r.identity_error < 1e-9
    huge = spark.createDataFrame([(k, [3e38 * (-1) ** k, float(k)], None) for k in range(4)], VECTORS)
    assert all(np.isfinite(r.whitened) for r in whiten(huge).collect())


def test_deviations_are_exact_and_held_at_the_largest_long():
    sums = [10_000_003, 20_000_001]
    x = np.array([[1_000_000, 2_000_000], [1_000_001, 2_000_007], [1 << 40, 0]], np.int64)
    want = [sum((7 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert deviations(x, 7, sums).tolist() == [min(w, LONG) for w in want]
    assert np.allclose(centred(x, 7, sums), [[(7 * int(v) - s) / 7 for v, s in zip(row, sums)] for row in x])
