"""Embedding near-dedup: an exact metric range join of vectors with equal labels.

On unit vectors, cosine >= c is Euclidean distance <= r = sqrt(2 - 2c).  All vectors of a label are a cell at first.  A
cell of more than `cell` vectors gets pivots; a vector's home is the part of its nearest pivot.  It is replicated to
every other part in which it may have a neighbour, by the triangle inequality three times.  Let p be x's pivot, q that of
a part with covering radius R, the largest distance of a home vector from q.  A neighbour y of x that lives at q has
d(y, q) <= R, so d(x, q) <= R + r; it is nearer to q than to p, so d(x, q) <= d(x, p) + 2r; and x is no more than r beyond
the plane between p and q.  The first rule keeps far vectors out of tight parts, the second vectors of tight parts out of
wide ones.  Parts that are still too large are split again with pivots of their own, so pivots grow with the vectors.  A
cell holds all neighbours of its home vectors and cells join independently: links of a vector are counted at home, and
each cell gives a spanning forest of its links rather than all pairs.

Pivots are taken farthest first from a hash sample of the cell: each is the sampled vector farthest from those before, so
every cluster gets one before any gets a second.  More are taken as long as they cover more; of the beginnings of that
sequence the one is used that leaves the fewest pairs to compare by the probes (sampled vectors that are no candidates),
if it rules out a share of 1 - `WORTH` at least and keeps a vector at `MOST_PLACES` places.  In a dense ball the
inequality rules nothing out; such a cell stays whole.  Equal vectors are one class with a count from the start, so
thousands of copies are a single point.  In a cell, home vectors meet all its vectors and replicas don't meet each
other.  A cell that stays above `block` points is dealt into blocks by hash and joined block by block, each task with at
most two blocks of bounded size, with nothing dropped; only there the work is quadratic.  Small cells are dealt to tasks
in packs.

Scale: the sample and pivots of a round take at most `pivot_bytes`, a bounded broadcast, and the largest cells come
first; a round is two maps, one for the radii.  Vectors move once for the classes and once, as they were given, for the
cells.  Components are found by contraction on DataFrames; scratch tables are deleted when they have been read.

Cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with
nothing and are kept.  Vectors of different lengths never link.  Ties in distance go to the first pivot.  Repeated
vec_ids are rows of their own that link if their vectors do; a null vec_id stands after all others in component_id.
Empty tables give no rows.  Extra columns are ignored by `embedding_components` and kept by `drop_near_vectors`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import connected_components
from .shared import cut, free, fresh

COSINE = 0.93
CELL = 32
BLOCK = 2048
#: Pivots of one cell in a round, what the sample and pivots of a round may take, and rounds.
MOST_PIVOTS = 4096
FIRST_PIVOTS = 256
PIVOT_BYTES = 12 << 20
ROUNDS = 8
WORTH = 0.97
MOST_PLACES = 4
#: Sampled vectors for each pivot wanted, and those that tell whether a split pays.
SAMPLE = 4
PROBES = 64
KEYS = ["label", "width", "cell"]


def _able() -> Column:
    """Whether a row (label, v) can link."""
    v = F.col("v")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))


def _classes(rows: DataFrame) -> DataFrame:
    """cls (a number), hi and lo (128 bits of label and vector), label, v, n rows, least id: one row per label and
    distinct vector that can link."""
    found = rows.filter("hi is not null").groupBy("hi", "lo", "label").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return cut(found.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")


def _unit(vectors) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = vectors.astype(np.float64) if isinstance(vectors, np.ndarray) else np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _parts(x: np.ndarray, pivots: np.ndarray, radius: float, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of each vector's nearest pivot, and (row, part) of the other parts it may have a neighbour in."""
    near, rows, parts = np.empty(len(x), np.int64), [], []
    step = max(1, (1 << 18) // len(pivots))
    for at in range(0, len(x), step):
        d = _distances(x[at : at + step], pivots)
        own, gap = d.argmin(1), d.min(1)
        near[at : at + step] = own
        row, part = np.nonzero((d <= gap[:, None] + 2 * radius + 1e-7) & (d <= radii[None, :] + radius + 1e-7))
        row, part = row[own[row] != part], part[own[row] != part]
        between = np.empty(len(row))
        for k in range(0, len(row), 1 << 13):  # pairs of pivots in full would be a thousand times the distances
            between[k : k + (1 << 13)] = np.einsum("ij,ij->i", pivots[own[row[k : k + (1 << 13)]]], pivots[part[k : k + (1 << 13)]])
        between = np.sqrt(np.maximum(2 - 2 * between, 0))
        plane = (d[row, part] ** 2 - gap[row] ** 2) / np.maximum(2 * between, 1e-12)
        may = (plane <= radius + 1e-7) | (between < 1e-7)
        rows.append(row[may] + at)
        parts.append(part[may])
    return near, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _farthest_first(x: np.ndarray, most: int, limit: int, radius: float) -> tuple[list[int], bool]:
    """Rows of x, each the farthest from those before, and whether more than `most` of them would help.

    They end when all of x is covered closely, or when more won't help up to `limit`.
    """
    order, gap, check = [0], _distances(x, x[:1])[:, 0], 64
    while len(order) < min(most, len(x)) and gap.max() > radius / 4:
        order.append(int(gap.argmax()))
        np.minimum(gap, _distances(x, x[order[-1:]])[:, 0], out=gap)
        if len(order) == check:
            # covered by a pivot that isn't itself: with clusters that share grows with the pivots, in a ball it doesn't
            covered = ((gap <= radius).sum() - len(order)) / max(1, len(x) - len(order))
            if covered < 0.5 * check / limit:
                return order, False
            check *= 4
    return order, len(order) == most < limit


def choose_pivots(sample: np.ndarray, most: int, limit: int, radius: float, places: float, whole: bool = False) -> tuple[np.ndarray | None, bool]:
    """Pivots for a cell from a sample of its unit vectors in random order, None if no number of them pays; and whether
    more than `most`, up to `limit`, would help.

    places: at how many places a vector is already; whole: the sample is all of the cell, so it needs no probes.
    """
    probes = len(sample) if whole else min(PROBES, len(sample) // 4)
    if probes < 1:
        return None, False
    asked, x = sample[:probes], sample if whole else sample[probes:]
    order, more = _farthest_first(x, most, limit, radius)
    if more:
        return None, True
    best, chosen = WORTH, None
    for m in sorted({*(k for k in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024, 2048, 4096) if k <= len(order)), len(order)} - {1}):
        pivots = x[order[:m]]
        near, gap = np.empty(len(sample), np.int64), np.empty(len(sample))
        for at in range(0, len(sample), 1024):
            d = _distances(sample[at : at + 1024], pivots)
            near[at : at + 1024], gap[at : at + 1024] = d.argmin(1), d.min(1)
        share = np.bincount(near, minlength=m) / len(sample)
        radii = np.zeros(m)
        np.maximum.at(radii, near, gap)
        own, row, part = _parts(asked, pivots, radius, radii)
        compared = (share[own].sum() + share[part].sum()) / probes
        if compared <= best and (1 + len(row) / probes) * places <= MOST_PLACES:
            best, chosen = compared, pivots
    return chosen, False


def _sample(points: DataFrame, rates: list[tuple], round_: int) -> dict[tuple, np.ndarray]:
    """Unit vectors by cell (label, width, cell, rate), in the order of a hash."""
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in KEYS)
    rated = F.broadcast(points.sparkSession.createDataFrame(rates, kinds + ", rate double"))
    place = F.pmod(F.xxhash64("cls", F.lit(2 + round_)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # rows, not Arrow: its buffers in the driver's JVM would be many times this sample
    rows = points.join(rated, KEYS).filter(place < F.col("rate")).select(*KEYS, "cls", "v", place.alias("place")).collect()
    found: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r["place"], r["cls"])):
        found.setdefault(tuple(r[k] for k in KEYS), []).append(r["v"])
    return {key: _unit(np.array(vectors, np.float64)) for key, vectors in found.items()}


def _pivots(points: DataFrame, done: set[tuple], radius: float, cell: int, most: int, pivot_bytes: int, round_: int) -> dict[tuple, np.ndarray]:
    """Pivots of the largest cells (label, width, cell) that are worth a split; what was looked at goes into `done`.

    A small sample comes first; a large one only where clusters show that they need more pivots.
    """
    sizes = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size"), F.count_if("home").alias("homes")).filter(F.col("size") > cell)
    # a cell has a few pivots and its probes at least, so no more cells than this fit
    least = pivot_bytes // ((2 + PROBES) * 8)
    large = [r for r in sizes.orderBy(F.desc("size"), *KEYS).limit(min(20_000, least)).collect() if tuple(r[k] for k in KEYS) not in done]
    facts = {tuple(r[k] for k in KEYS): (r["size"], min(most, max(2, r["size"] // SAMPLE)), r["size"] / max(1, r["homes"])) for r in large}
    want, out = {key: min(limit, FIRST_PIVOTS) for key, (_, limit, _) in facts.items()}, {}
    while want:
        rates, left = {}, pivot_bytes
        for key, n in want.items():
            drawn = min(facts[key][0], SAMPLE * n + PROBES)
            if left < drawn * 8 * key[1]:
                break
            left -= drawn * 8 * key[1]
            rates[key] = drawn / facts[key][0]
        if not rates:
            break
        samples = _sample(points, [(*key, rate) for key, rate in rates.items()], round_)
        later = {}
        for key, rate in rates.items():
            done.add(key)
            size, limit, places = facts[key]
            if len(samples.get(key, ())) >= 8:
                pivots, more = choose_pivots(samples.pop(key), want[key], limit, radius, places, rate >= 1)
                if more:
                    later[key] = limit
                elif pivots is not None:
                    out[key] = pivots
        want = later
    return out


def _by_cell(batch: pa.RecordBatch) -> dict[tuple, list[int]]:
    rows_of: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(*(batch.column(n).to_pylist() for n in KEYS))):
        rows_of.setdefault(key, []).append(k)
    return rows_of


def _grid(batch: pa.RecordBatch, rows: list[int], width: int) -> np.ndarray:
    return _unit(batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width))


def _radii(points: DataFrame, shipped) -> dict[tuple, np.ndarray]:
    """The covering radius of each part: the largest distance of a vector at home there."""
    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            home = batch.column("home").to_pylist()
            for key, rows in _by_cell(batch).items():
                pivots, rows = shipped.value.get(key), [k for k in rows if home[k]]
                if pivots is None or not rows:
                    continue
                radii = held.setdefault(key, np.full(len(pivots), -1.0))
                x = _grid(batch, rows, key[1])
                for at in range(0, len(x), step := max(1, (1 << 18) // len(pivots))):
                    d = _distances(x[at : at + step], pivots)
                    np.maximum.at(radii, d.argmin(1), d.min(1))
        columns = [list(c) for c in zip(*((*key, p, r) for key, radii in held.items() for p, r in enumerate(radii.tolist()) if r >= 0))] or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*KEYS, "part", "radius"])

    kinds = [*(to_arrow_type(points.schema[k].dataType) for k in KEYS), pa.int32(), pa.float64()]
    names = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in KEYS)
    # a row for each pivot, which are bounded
    rows = points.mapInArrow(run, names + ", part int, radius double").groupBy(*KEYS, "part").agg(F.max("radius").alias("radius")).collect()
    out = {key: np.full(len(pivots), -10.0) for key, pivots in shipped.value.items()}  # parts without a home vector take no replicas
    for r in rows:
        out[tuple(r[k] for k in KEYS)][r["part"]] = r["radius"]
    return out


def _split(points: DataFrame, centres: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """The points with cells split by their pivots; those of other cells as they are."""
    context = points.sparkSession.sparkContext
    first = context.broadcast(centres)
    radii = _radii(points, first)
    shipped = context.broadcast({key: (pivots, radii[key]) for key, pivots in centres.items()})
    names = points.columns

    def place(batches):
        for batch in batches:
            rows, cells, homes = [], [], []
            was_home = batch.column("home").to_pylist()
            for key, some in _by_cell(batch).items():
                if key not in shipped.value:
                    rows += some
                    cells += [key[2]] * len(some)
                    homes += [was_home[k] for k in some]
                    continue
                # a replica meets home vectors only, so it goes where it may have a home neighbour, at its own part too
                near, at, part = _parts(_grid(batch, some, key[1]), shipped.value[key][0], radius, shipped.value[key][1])
                rows += some + [some[k] for k in at.tolist()]
                cells += [f"{key[2]}/{p}" for p in [*near.tolist(), *part.tolist()]]
                homes += [was_home[k] for k in some] + [False] * len(at)
            out = batch.take(pa.array(rows, pa.int64()))
            columns = {**{n: out.column(n) for n in names}, "cell": pa.array(cells, pa.string()), "home": pa.array(homes, pa.bool_())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    out = cut(points.mapInArrow(place, points.schema), "vector-points")
    first.destroy()
    shipped.destroy()
    return out


def partition(classes: DataFrame, radius: float, cell: int = CELL, most_pivots: int = MOST_PIVOTS, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """label, width, cls, n, v, cell, home: the classes (label, v, cls, n) in cells, with their replicas."""
    points = classes.select("label", F.size("v").alias("width"), "cls", "n", "v", F.lit("").alias("cell"), F.lit(True).alias("home"))
    done, old = set(), None
    for round_ in range(ROUNDS):
        centres = _pivots(points, done, radius, cell, most_pivots, pivot_bytes, round_)
        if not centres:
            break
        points = _split(points, centres, radius)
        free(old)
        old = points
    return points


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b link; both have at most a block of rows."""
    out = np.empty((len(a), len(b)), bool)
    for at in range(0, len(a), 512):
        np.greater_equal(a[at : at + 512] @ b.T, cosine, out=out[at : at + 512])
    return out


def _forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(row, column) links that span every tree of the link matrix, breadth first.

    same: row k is column k as well, and links among them are in both places.
    """
    rows, columns, out = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool), []
    for first in np.flatnonzero(linked.any(1)).tolist():
        if not rows[first]:
            continue
        rows[first] = False
        if same:
            columns[first] = False
        todo = [(first, True)]
        while todo:
            k, is_row = todo.pop()
            ahead = linked[k] & columns if is_row else linked[:, k] & rows
            for j in np.flatnonzero(ahead).tolist():
                (columns if is_row else rows)[j] = False
                both = same and j < len(rows)
                if both:
                    rows[j] = columns[j] = False
                out.append((k, j) if is_row else (j, k))
                todo.append((j, both or not is_row))
    return out


def embedding_components(vectors: DataFrame, vec_id="vec_id", embedding="embedding", label="label", cosine=COSINE, cell=CELL, block=BLOCK, most_pivots=MOST_PIVOTS, pivot_bytes=PIVOT_BYTES) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    rows = rows.select("id", "label", "v", *(F.when(_able(), F.xxhash64(F.lit(seed), "label", "v")).alias(name) for seed, name in enumerate(("hi", "lo"))))
    classes = _classes(rows)
    radius = math.sqrt(2 - 2 * cosine)
    points = partition(classes, radius, cell, most_pivots, pivot_bytes)
    # into how many blocks each cell is dealt
    sizes = points.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = points.join(sizes, KEYS)
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    # block pair (x, y) with x <= y: a member of block k goes to (min(k, j), max(k, j)) for every j
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    # cells of one block share a task in packs of about a block of points
    packs = max(1, points.count() // block)
    pack = F.when(F.col("blocks") == 1, F.concat(F.lit("pack "), F.pmod(F.xxhash64(*KEYS), F.lit(packs)).cast("string"))).otherwise(F.concat_ws(" ", *KEYS))
    groups = dealt.select("label", "width", "cell", "cls", "n", "home", "v", own.alias("block"), pack.alias("pack"), F.explode(pairs).alias("pair"))

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [one(key[1], key[2], some) for _, some in group.groupby(KEYS, sort=False)]
        return pd.concat(parts, ignore_index=True)

    def one(x: int, y: int, group: pd.DataFrame) -> pd.DataFrame:
        matrix = _unit(group["v"])
        cls, n, home, own_block = (group[c].to_numpy() for c in ("cls", "n", "home", "block"))
        if x == y:  # home vectors against all, which begin with them
            left = np.flatnonzero((own_block == x) & home)
            right = np.concatenate([left, np.flatnonzero((own_block == x) & ~home)])
        else:
            left, right = np.flatnonzero(own_block == x), np.flatnonzero(own_block == y)
        links = np.zeros(len(group), np.int64)
        if not len(left) or not len(right):
            return pd.DataFrame({"cls": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": pd.array([], "Int64")})
        linked = _linked(matrix[left], matrix[right], cosine)
        # pairs of two replicas are found where one of them is at home
        linked &= (home[left][:, None] | home[right][None, :]) & (cls[left][:, None] != cls[right][None, :])
        links[left] = np.where(home[left], linked @ n[right], 0)
        if x != y:
            links[right] = np.where(home[right], n[left] @ linked, 0)
        edges = [(int(cls[left[i]]), int(cls[right[j]])) for i, j in _forest(linked, x == y)]
        some = np.flatnonzero(links)
        # hashes use all 64 bits, which a column that pandas makes of integers and gaps would lose
        column = {
            "cls": np.concatenate([cls[some], np.array([a for a, _ in edges], np.int64)]),
            "links": np.concatenate([links[some], np.zeros(len(edges), np.int64)]),
            "other": pd.array([None] * len(some) + [b for _, b in edges], "Int64"),
        }
        return pd.DataFrame(column)

    found = cut(groups.groupBy("pack", "pair.x", "pair.y").applyInPandas(join, "cls long, links long, other long"), "vector-links")
    free(points)
    roots = connected_components(found.filter("other is not null").select(F.xxhash64("cls").alias("a"), F.xxhash64("other").alias("b")))
    links = found.groupBy(F.col("cls").alias("c2")).agg(F.sum("links").alias("links"))
    members = classes.select("hi", "lo", "cls", "n", "least").join(links, F.col("cls") == F.col("c2"), "left").join(roots, F.xxhash64("cls") == F.col("node"), "left")
    members = cut(members.select("hi", "lo", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", F.xxhash64("cls")).alias("root")), "vector-members")
    free(found, classes, roots)
    firsts = cut(members.groupBy(F.col("root").alias("r2")).agg(F.min("least").alias("component")), "vector-firsts")
    info = members.join(firsts, F.col("root") == F.col("r2")).select(F.col("hi").alias("h2"), F.col("lo").alias("l2"), "n", "links", "component")
    result = rows.select("id", "hi", "lo").join(info, (F.col("hi") == F.col("h2")) & (F.col("lo") == F.col("l2")), "left")
    component = F.coalesce("component", "id")
    return result.select(F.col("id").alias(vec_id), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_vectors(vectors: DataFrame, vec_id="vec_id", **options) -> DataFrame:
    """The vectors whose id is their component's smallest, with all their columns."""
    mark, = fresh(vectors, "kept_id")
    kept = embedding_components(vectors, vec_id=vec_id, **options).filter("kept").select(F.col(vec_id).alias(mark)).distinct()
    return vectors.join(kept, F.col(vec_id).eqNullSafe(F.col(mark)), "left_semi")
