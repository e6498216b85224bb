"""Mixing sources to target weights by the cube method.

Each document gets an expected number of copies, its source's target over its source's size; the whole part
is taken for sure and the fraction is an inclusion probability.  The flight phase moves the probabilities along
the null space of the two balancing constraints (documents and tokens), up or down at random so that each keeps
its expectation, until all but two at most are 0 or 1.  Moves decide the largest documents first, so those two are
small; their landing is the outcome nearest to the expected tokens.

Scale: the text is read once, to count tokens; afterwards rows hold an id, a source, a size and a hash.  Rows alike in
all of these are one unit with a number of rows (summed on the map side), so a row repeated a million times is one
unit: its whole copies are sure and only its fraction flies.  A flight runs in blocks of a source of about `block_rows`
units, so a source with a third of all rows is as many blocks; each block hands its few undecided units to the next
round, which deals them into blocks again, until every source fits one block.  Rounds shrink the units by over 80 times
each.  Sources, not documents, are collected: one row each, for the targets, at most `most_sources` of them and
`SOURCE_BYTES` of names; more are refused, so the plan that is broadcast has a proven bound.

Random choices are hashes of the document, its block and the seed: reruns and lost executors agree.

Cases: a null or empty text has size 0 and is never taken.  A null source is a source, the last.  Repeated rows share
their unit's copies evenly; which of them has one more is of no matter, as they are equal.  Rows of equal size fly in
the order of their text's hash and id.  A null or large id is carried as it is.  A text of any length is one document
and counts whole.  A source of size 0 has target 0; empty tables give empty results.  Extra columns are ignored by
`mix_sources` and kept by `take_mix`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, cut, fresh, sliced

BLOCK_ROWS = 256
WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3.0
MOST_SOURCES = 100_000
SOURCE_BYTES = 32 << 20
#: Rows of a unit that are made at once.
STRIDE = 1024


def targets_of(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, total: float | None = None) -> dict[str | None, float]:
    """Tokens that each source gives: its weight's share of the total, at most `most` times its size; the
    excess goes to the others by weight until none is above.  Weights repeat over the sources in code-point
    order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, free = float(sum(sizes.values()) if total is None else total), {}, list(order)
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
        left = max(0.0, left - sum(out[s] for s in over))
        free = [s for s in free if s not in out]
    return out


class _Draws:
    """A stream of numbers in [0, 1) that depends on its name alone."""

    def __init__(self, *name):
        self.name, self.k, self.left = repr(name).encode(), 0, []

    def __call__(self) -> float:
        if not self.left:
            block = b"".join(hashlib.sha256(self.name + b"%d,%d" % (self.k, j)).digest() for j in range(8))
            self.left = [int.from_bytes(block[j : j + 8], "big") / 2.0**64 for j in range(0, len(block), 8)]
            self.k += 1
        return self.left.pop()


def flight(sizes: list[float], chances: list[float], draw: _Draws) -> list[float]:
    """Probabilities after the flight: all but two at most are 0 or 1.  Both totals stay as they were.

    Every move decides the largest undecided document, or another that gets to 0 or 1 before it: the direction is
    that document's unit vector projected on the null space of the two totals over all that is undecided.  So
    what stays behind is small.
    """
    out = np.array(chances, float)
    size = np.array(sizes, float)
    open_units = np.flatnonzero((out > 0) & (out < 1))
    open_units = open_units[np.argsort(-size[open_units], kind="stable")]
    while len(open_units) > 1:
        s, p = size[open_units], out[open_units]
        scaled = s / s[0] if s[0] else s
        n, s1, s2 = len(s), scaled.sum(), (scaled * scaled).sum()
        det = n * s2 - s1 * s1
        if det > 1e-9 * n * s2:
            # how much of each unit vector the null space holds: none of a document whose size is like no other's
            free = 1 - (s2 - 2 * s1 * scaled + n * scaled * scaled) / det
            chosen = int(np.argmax(free > 1e-7))
            if free[chosen] <= 1e-7:
                break
            u = -((s2 - s1 * scaled[chosen]) + (n * scaled[chosen] - s1) * scaled) / det
        else:
            chosen, u = 0, np.full(n, -1.0 / n)
        u[chosen] += 1
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-12, (1 - p) / u, np.where(u < -1e-12, -p / u, np.inf)).min()
            down = np.where(u > 1e-12, p / u, np.where(u < -1e-12, (p - 1) / u, np.inf)).min()
        moved = p + (up if draw() * (up + down) < down else -down) * u
        moved[moved < 1e-9] = 0.0
        moved[moved > 1 - 1e-9] = 1.0
        out[open_units] = moved
        open_units = open_units[(moved > 0) & (moved < 1)]
    return out.tolist()


def landing(sizes: list[float], chances: list[float]) -> list[float]:
    """Decides what the flight left: of all outcomes of the undecided documents (two at most), those whose
    document total is their expectation rounded up or down, and of these the nearest to the expected tokens."""
    out, open_units = list(chances), [k for k, c in enumerate(chances) if 0.0 < c < 1.0]
    if not open_units:
        return out
    size, chance = np.array([sizes[k] for k in open_units]), np.array([chances[k] for k in open_units])
    outcomes = (np.arange(1 << len(open_units))[:, None] >> np.arange(len(open_units))) & 1
    off = np.abs(outcomes @ size - chance @ size)
    off[np.abs(outcomes.sum(1) - chance.sum()) >= 1] = np.inf
    for k, x in zip(open_units, outcomes[int(off.argmin())].tolist()):
        out[k] = float(x)
    return out


def _flyer(names: list[str], seed: int, depth: int, last: bool):
    """The flight of one block, and its landing in the last round."""

    def fly(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("tag", "ascending"), ("doc_id", "ascending")])
        draw = _Draws(seed, depth, *(str(k.as_py()) for k in key), group.num_rows)
        sizes = group["size"].to_numpy().astype(float).tolist()
        chances = flight(sizes, group["chance"].to_pylist(), draw)
        chances = landing(sizes, chances) if last else chances
        return group.set_column(group.schema.get_field_index("chance"), "chance", pa.array(chances, pa.float64())).select(names)

    return fly


def token_sizes(docs: DataFrame, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """doc_id, source, size (words between white space) and a hash of the text, of every row."""
    schema = T.StructType([docs.schema[doc_id], docs.schema[source], T.StructField("size", T.LongType()), T.StructField("tag", T.LongType())])

    def count(batches):
        for batch in sliced(batches):
            bodies = as_bytes(batch.column(text))
            tags = [int.from_bytes(hashlib.blake2b(b or b"", digest_size=8).digest(), "big", signed=True) for b in bodies]
            sizes = pa.array([len(b.split()) if b else 0 for b in bodies], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), batch.column(source), sizes, pa.array(tags, pa.int64())], names=schema.names)

    return docs.select(doc_id, source, text).mapInArrow(count, schema)


def _mixed_units(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, most=MOST_REPEATS, block_rows=BLOCK_ROWS, seed=1, most_sources=MOST_SOURCES) -> DataFrame:
    """One row per unit of equal rows: doc_id, source, size, tag, times (its rows), source_size, target, copies (of all)."""
    spark = docs.sparkSession
    sized = token_sizes(docs, doc_id, text, source).toDF("doc_id", "source", "size", "tag")
    units = cut(sized.groupBy("doc_id", "source", "size", "tag").agg(F.count(F.lit(1)).alias("times")), "mix-units")
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    bytes_ = per_source.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).first()
    if bytes_[0] > most_sources or (bytes_[1] or 0) > SOURCE_BYTES:
        raise ValueError(f"{bytes_[0]} sources with names of {bytes_[1]} bytes; group them into at most {most_sources}")
    stats = {r["source"]: r for r in per_source.collect()}
    targets = targets_of({s: r["size"] for s, r in stats.items()}, weights, most)
    rows = [(s, r["size"], targets[s], targets[s] / r["size"] if r["size"] else 0.0, max(1, -(-r["n"] // block_rows))) for s, r in stats.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "plan_source string, source_size long, target double, rate double, blocks long"))
    frame = units.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    wanted = F.when(F.col("size") > 0, F.col("rate") * F.col("times")).otherwise(0.0)
    frame = frame.withColumns({"sure": F.floor(wanted), "chance": wanted - F.floor(wanted)})

    schema = T.StructType([*frame.schema.fields])
    decided, depth = [], 0
    while True:
        most_blocks = max([1, *(r[4] for r in rows)])
        last = most_blocks == 1
        key = F.xxhash64("doc_id", "tag", "size", F.lit(seed), F.lit(depth))
        frame = frame.withColumn("block", F.pmod(key, F.col("blocks")))

        fly = _flyer(schema.names, seed, depth, last)
        moving = (F.col("chance") > 0) & (F.col("chance") < 1)
        if depth == 0:
            decided.append(frame.filter(~moving).drop("block"))
        flown = cut(frame.filter(moving).groupBy("source", "block").applyInArrow(fly, schema), f"mix-{depth}")
        decided.append(flown.filter(~moving))
        if last:
            break
        # what each source has left sets its blocks for the next round
        left = {r["source"]: r["n"] for r in flown.filter(moving).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = [(*r[:4], max(1, -(-left.get(r[0], 0) // block_rows))) for r in rows]
        again = F.broadcast(spark.createDataFrame([(r[0], r[4]) for r in rows], "again_source string, again long"))
        frame = flown.filter(moving).join(again, F.col("source").eqNullSafe(F.col("again_source")), "left").withColumn("blocks", F.col("again")).select(*schema.names)
        depth += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "tag", "times", "source_size", "target", (F.col("sure") + F.col("chance")).cast("long").alias("copies"))


def _counted(rows: DataFrame, times: str, name: str) -> DataFrame:
    """Each row `times` times, with its number from 0 as `name`; long counts are made a stride at a time."""
    some = rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {STRIDE}"))))
    first = F.col(name) * STRIDE
    return some.withColumn(name, F.explode(F.sequence(first, F.least(first + STRIDE, F.col(times)) - 1)))


def mix_sources(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, most=MOST_REPEATS, block_rows=BLOCK_ROWS, seed=1, most_sources=MOST_SOURCES) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target (its source's), copies, taken (size * copies), tag."""
    units = _mixed_units(docs, doc_id, text, source, weights, most, block_rows, seed, most_sources)
    rows = _counted(units, "times", "place")
    copies = F.expr("copies div times + int(place < copies % times)")
    rows = rows.withColumn("copies", copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tag")


def take_mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all its columns.

    Decisions go back to the rows by id, source and text hash.
    """
    tag, mixed, alike_rows, m_id, m_source, m_tag = fresh(docs, "tag", "mixed", "alike_rows", "m_id", "m_source", "m_tag")
    units = _mixed_units(docs, doc_id, text, source, **options).filter("copies > 0")
    units = cut(units.select("doc_id", "source", "tag", "copies", "times"), "mix-copies").toDF(m_id, m_source, m_tag, mixed, alike_rows)
    schema = T.StructType([*docs.schema.fields, T.StructField(tag, T.LongType())])

    def tagged(batches: Iterator[pa.RecordBatch]):
        for batch in sliced(batches):
            tags = [int.from_bytes(hashlib.blake2b(b or b"", digest_size=8).digest(), "big", signed=True) for b in as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.int64())], names=schema.names)

    rows = docs.mapInArrow(tagged, schema)
    alike = F.col(doc_id).eqNullSafe(F.col(m_id)) & F.col(source).eqNullSafe(F.col(m_source)) & (F.col(tag) == F.col(m_tag))
    # decisions grow with the documents: a shuffle join at every size
    joined = rows.join(units.hint("merge"), alike, "inner").drop(m_id, m_source, m_tag)
    out = joined.filter(F.col(alike_rows) == 1)
    if not units.filter(F.col(alike_rows) > 1).isEmpty():
        # rows alike in id, source and text are equal to the mix: one of them stands for all their copies
        out = out.union(joined.filter(F.col(alike_rows) > 1).dropDuplicates([doc_id, source, tag]))
    return _counted(out, mixed, tag).select(*docs.columns)
