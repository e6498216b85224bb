"""Greedy lexical duplicates of unbounded pools: a text stays unless an earlier one that stayed is as similar as a threshold.

The outcome is that of going through a pool in order, which is the first maximal independent set of the graph of similar
texts.  It is found without an ordered group:

1. Texts with the same words are one class; only its first row can stay.  A class is a set of 64-bit hashes of words in
   one global order: the `common` most frequent words come last (a bounded broadcast), so the first ones are rare.
2. Two sets of Jaccard similarity t or more share one of their first |x| - ceil(t |x|) + 1 words (prefix filter).  A
   class that comes before all others under each of its prefix words has no earlier rival and stays.  Only such leaders
   are compared with what else stands under their words, at most one under each word, so that thousands of near copies
   cost a comparison each; what is similar goes.  This is repeated as long as it decides a good share.
3. Of what is left, pairs that share a prefix word, have lengths within t and can still reach the overlap by their
   places (length and positional filters) are compared.  Words with many texts are dealt into pairs of blocks.
4. On the links: what has no undecided earlier neighbour stays, its neighbours go, until no link is left.  The number
   of rounds is the longest chain of decisions that depend on each other.

Scale: joins and aggregations by key.  What moves are prefix words (a fifth of the words at a threshold of 0.8), once a
round and only of undecided classes, in the last step with sketches, so that a pair is judged where two texts meet under
a word, and the words of the pairs whose sketches leave them in reach; the texts never.  The hash of a word holds its pool, so pools share none.  Tables between
rounds are written to the shared folder and deleted when they have been read.

Cases: texts without words are compared letter by letter, with each other, without white space at the ends; null is
empty.  A threshold of 1 or more keeps all rows, one of 0 or less the first with words of each pool.  Equal ranks: by the
hash of the words, then in the order the rows are read.  An empty table gives an empty one; extra columns stay.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import retrieval_tokens, stripped
from ..sources.staging import staged, unstaged

#: Frequent words that are put last.
COMMON = 50_000
#: Texts under a word that are compared in one task.
BLOCK = 1_000
#: Share of the undecided that a round of leaders has to decide to be followed by another one.
WORTH = 0.1
ROUNDS = 6
#: Least bits of a sketch: whether a set's words with that hash are odd in number.  Sets of more words have more bits, as
#: otherwise the sketches of any two large sets would be near.
SKETCH = 512
#: Bits of the folded sketch that goes with each prefix word; whole sketches go with those of sets that it can't tell apart.
FOLDED = 256
#: Pairs whose classes are broadcast to the texts, so that only their words move.
BROADCAST = 200_000


class Sets(NamedTuple):
    """The classes with words, and the words of all rows, which are read from the texts when they are asked for."""

    classes: DataFrame  # row, cls
    words: DataFrame  # row, words


def _least_overlap(size, threshold: float):
    return F.ceil(F.lit(threshold) * size - 1e-9)


def _bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets: the power of two from 0.75 bits a word on."""
    return np.maximum(SKETCH, 2 ** np.ceil(np.log2(np.maximum(1, 0.75 * sizes))).astype(np.int64))


def _folded(sketch: Column, longs: Column) -> Column:
    """The sketch with fewer bits, as if it had been made with them."""
    one = lambda k: F.aggregate(F.sequence(k, F.size(sketch) - 1, longs), F.lit(0).cast("long"), lambda z, i: z.bitwiseXOR(F.get(sketch, i)))
    return F.when(F.size(sketch) == longs, sketch).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), one))


def _apart(x: Column, y: Column) -> Column:
    """Bits that differ between two sketches, no more than words that only one set has."""
    longs = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(_folded(x, longs), _folded(y, longs), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)


def _in_reach(apart: Column, sizes: Column, threshold: float) -> Column:
    return apart * F.lit(1 + threshold) <= F.lit(1 - threshold) * sizes + 1e-9


def _ordered(sets: DataFrame, threshold: float, common: int) -> DataFrame:
    """row, size, prefix (the first words in the global order) and sketch of every set (row, words)."""
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequent = {r.word: k for k, r in enumerate(reversed(counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(common).collect()))}
    known = np.array(sorted(frequent), np.int64)
    places = np.array([frequent[w] + 1 for w in known.tolist()], np.int64)
    shipped = sets.sparkSession.sparkContext.broadcast((known, places))

    def order(batches):
        known, places = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield ordered(batch.slice(at, 1024), known, places)

    def ordered(batch, known, places):
        lists = batch.column("words")
        words, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
        place = np.where(known[at] == words, places[at], 0) if len(known) else np.zeros(len(words), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        width = _bits(sizes)
        starts = np.concatenate(([0], np.cumsum(width)))
        bits = np.bincount(starts[row] + (words & (width[row] - 1)), minlength=starts[-1]) & 1
        sketches = np.packbits(bits.astype(np.uint8)).view(np.int64)
        words = words[np.lexsort((words, place, row))]
        n_prefix = np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1)
        first = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(n_prefix, sizes)
        ends = np.concatenate(([0], np.cumsum(n_prefix))).astype(np.int32)
        grid = (starts // 64).astype(np.int32)
        columns = [batch.column("row"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(words[first])), pa.ListArray.from_arrays(pa.array(grid), pa.array(sketches))]
        return pa.RecordBatch.from_arrays(columns, names=["row", "size", "prefix", "sketch"])

    return sets.mapInArrow(order, "row long, size int, prefix array<long>, sketch array<long>")


def _prefixes(left: DataFrame) -> DataFrame:
    return left.select("cls", "size", F.posexplode("prefix").alias("at", "word"))


def _may_reach(x: str, y: str, threshold: float) -> Column:
    """Length and positional filter of two prefix rows with the same word."""
    size_x, size_y, at_x, at_y = (F.col(f"{s}.{c}") for c in ("size", "at") for s in (x, y))
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (size_x + size_y) - 1e-9)
    within = (size_y >= F.lit(threshold) * size_x - 1e-9) & (size_x >= F.lit(threshold) * size_y - 1e-9)
    return within & (1 + F.least(size_x - at_x - 1, size_y - at_y - 1) >= needed)


def _similar(pairs: DataFrame, left: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) of classes whose similarity reaches the threshold.

    Bits that differ between two sketches are words that only one has, so most pairs go by their sketches; words move
    for the rest alone.
    """
    seen = lambda side: left.select(F.col("cls").alias(side), F.col("size").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    both = pairs.join(seen("a"), "a").join(seen("b"), "b")
    near = staged(both.filter(_in_reach(_apart(F.col("s_a"), F.col("s_b")), F.col("n_a") + F.col("n_b"), threshold)).select("a", "b"), "near-pairs")
    asked = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    some = sets.classes.join(asked, "cls", "left_semi").select("row", "cls")
    some = F.broadcast(some) if near.count() <= BROADCAST else some
    words = sets.words.join(some, "row").select("cls", "words")
    mine = lambda side: words.select(F.col("cls").alias(side), F.col("words").alias(f"w_{side}"))
    shared = F.size(F.array_intersect("w_a", "w_b"))
    found = near.join(mine("a"), "a").join(mine("b"), "b").filter(shared / (F.size("w_a") + F.size("w_b") - shared) >= threshold)
    out = staged(found.select("a", "b"), "similar")
    unstaged(near)
    return out


def _leaders(left: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes that come first under each of their prefix words, and the classes that are similar to one of them."""
    # plain columns under the window: a struct would be shuffled beside its parts
    first = Window.partitionBy("word").orderBy("cls")
    under = _prefixes(left).select("cls", "size", "at", *(F.first(c).over(first).alias(f"first_{c}") for c in ("cls", "size", "at")))
    under = under.select(F.struct("cls", "size", "at").alias("y"), F.struct(*(F.col(f"first_{c}").alias(c) for c in ("cls", "size", "at"))).alias("x"))
    heads = staged(under.groupBy(F.col("y.cls").alias("b"), F.col("x.cls").alias("a")).agg(F.bool_or(_may_reach("x", "y", threshold)).alias("near")), "heads")
    leaders = staged(heads.groupBy("b").agg(F.bool_and(F.col("a") == F.col("b")).alias("leads")).filter("leads").select(F.col("b").alias("cls")), "leaders")
    pairs = heads.filter("a <> b AND near").join(leaders.withColumnRenamed("cls", "a"), "a", "left_semi").select("a", "b")
    alike = _similar(pairs, left, sets, threshold)
    gone = staged(alike.select(F.col("b").alias("cls")).distinct(), "similar-to-leaders")
    unstaged(heads, alike)
    return leaders, gone


def _near_sketches(x: str, y: str, threshold: float) -> Column:
    """Whether the sketches of two prefix rows leave their sets in reach: the folded ones, then the whole ones, if any."""
    sizes = F.col(f"{x}.size") + F.col(f"{y}.size")
    folded = reduce(Column.__add__, (F.bit_count(F.col(f"{x}.bits_{k}").bitwiseXOR(F.col(f"{y}.bits_{k}"))) for k in range(FOLDED // 64)))
    whole = F.when(F.col(f"{x}.sketch").isNull() | F.col(f"{y}.sketch").isNull(), True).otherwise(_in_reach(_apart(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")), sizes, threshold))
    return _in_reach(folded, sizes, threshold) & whole


def _candidates(left: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b: the distinct pairs of classes under a prefix word that lengths, places and sketches leave, a before b.

    Sketches stand beside the words, so that a pair is judged where it is made: pairs grow with the square of a word's
    texts, and those that go are never written.
    """
    sketch, longs = F.col("sketch"), FOLDED // 64
    folded = left.select("cls", "size", "prefix", _folded(sketch, F.lit(longs)).alias("bits"), F.when(F.col("size") * 0.75 > FOLDED, sketch).alias("sketch"))
    prefixes = folded.select("cls", "size", "sketch", *(F.col("bits")[k].alias(f"bits_{k}") for k in range(longs)), F.posexplode("prefix").alias("at", "word"))
    frequent = staged(_prefixes(left).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("word", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "frequent-words")
    fits = (F.col("x.cls") < F.col("y.cls")) & _may_reach("x", "y", threshold) & _near_sketches("x", "y", threshold)
    few = prefixes.join(frequent, "word", "left_anti")
    pairs = few.alias("x").join(few.alias("y"), "word").filter(fits).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    if not frequent.isEmpty():
        dealt = prefixes.join(frequent, "word").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        # a text meets those of every block: as the left one in its own, as the right one in all
        right = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = dealt.withColumn("other", F.col("own")).alias("x").join(right.alias("y"), ["word", "other"]).filter(fits)
        pairs = pairs.unionAll(many.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")))
    out = staged(pairs.distinct(), "candidates")
    unstaged(frequent)
    return out


def _links(left: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b: all similar pairs of classes, a before b."""
    pairs = _candidates(left, threshold, block)
    out = _similar(pairs, left, sets, threshold)
    unstaged(pairs)
    return out


def first_independent(links: DataFrame) -> DataFrame:
    """node: what goes, of links (a, b) with a before b, if every node without an earlier neighbour that stays stays."""
    gone, links = [], staged(links.select("a", "b"), "links")
    while not links.isEmpty():
        free = links.select(F.col("a").alias("node")).join(links.select(F.col("b").alias("node")), "node", "left_anti").distinct()
        out = staged(links.join(free.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "going")
        gone.append(out)
        rest = links.join(out.withColumnRenamed("node", "a"), "a", "left_anti").join(out.withColumnRenamed("node", "b"), "b", "left_anti")
        links, old = staged(rest, "links"), links
        unstaged(old)
    if not gone:
        return links.select(F.col("a").alias("node"))
    whole = gone[0]
    for part in gone[1:]:
        whole = whole.unionAll(part)
    return whole


def mark_lexical(rows: DataFrame, rank: str, threshold: float, pool: list[str] = [], text: str = "text", name: str = "kept", common: int = COMMON, block: int = BLOCK) -> DataFrame:  # noqa: B006
    """The rows with `name`: whether a row stays."""
    if threshold >= 1:
        return rows.withColumn(name, F.lit(True))
    row, = fresh(rows, "row")
    rows = staged(rows.withColumn(row, F.monotonically_increasing_id()), "lexical-rows")
    words = F.array_distinct(F.transform(retrieval_tokens(F.col(text)), lambda t: F.xxhash64(t, *pool)))
    bare = stripped(F.coalesce(F.col(text), F.lit("")))
    base = rows.select(F.col(row).alias("row"), F.col(rank).alias("rank"), F.xxhash64(F.lit(3), *pool).alias("pool"), words.alias("words"), bare.alias("bare"))
    whole = F.when(F.size("words") == 0, F.concat(F.lit("-"), "bare")).otherwise(F.lit("+") if threshold <= 0 else F.array_join(F.array_sort("words"), " "))
    base = base.select("row", "rank", (F.size("words") > 0).alias("worded"), *(F.xxhash64(F.lit(seed), "pool", whole).alias(h) for seed, h in ((1, "hi"), (2, "lo"))))
    found = base.groupBy("hi", "lo").agg(F.min(F.struct("rank", "row")).alias("first"), F.first("worded").alias("worded")).select("first.*", "hi", "lo", "worded")
    # numbers that rise with the order of the pools
    found = found.repartitionByRange("rank", "hi", "lo").sortWithinPartitions("rank", "hi", "lo").withColumn("cls", F.monotonically_increasing_id())
    classes = staged(found.select("row", "cls", "worded"), "lexical-classes")
    gone = []
    if threshold > 0:
        sets = Sets(classes.filter("worded").select("row", "cls"), rows.select(F.col(row).alias("row"), words.alias("words")))
        left = staged(_ordered(sets.words, threshold, common).join(sets.classes, "row").drop("row"), "lexical-sets")
        for _ in range(ROUNDS):
            before = left.count()
            if not before:
                break
            leaders, out = _leaders(left, sets, threshold)
            gone.append(out)
            rest = staged(left.join(leaders, "cls", "left_anti").join(out, "cls", "left_anti"), "lexical-sets")
            unstaged(left, leaders)
            left = rest
            if left.count() > (1 - WORTH) * before:
                break
        gone.append(first_independent(_links(left, sets, threshold, block)).withColumnRenamed("node", "cls"))
        unstaged(left)
    kept = classes.select("cls", F.col("row").alias(row))
    for part in gone:
        kept = kept.join(part, "cls", "left_anti")
    kept = kept.select(row, F.lit(True).alias(name))
    return rows.join(kept, row, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(row)
