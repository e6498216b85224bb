"""Bloom filters on DataFrame functions: an array of 64-bit words in a table of one row.

A key sets a few bits; the bits of all keys are combined by OR per word, with partial sums on the map side.  Rows
test a filter through a scalar subquery.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
HASHES = 4


def bloom_words(keys: int) -> int:
    return max(1, math.ceil(keys * BITS_PER_KEY / 64))


def _bits(key: Column, words: int, level: int) -> list[Column]:
    """The positions of the key's bits in a filter of so many words."""
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level + k)), F.lit(64 * words)) for k in range(HASHES)]


def bloom_filter(keys: DataFrame, words: int, level: int) -> DataFrame:
    """One row: the filter of the keys as an array of words."""
    spots = keys.select(F.explode(F.array(*_bits(F.col("key"), words, level))).alias("bit"))
    set_bits = spots.select(F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    # every word once, the empty ones from the range: no more entries than the filter has
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    parts = set_bits.unionAll(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = parts.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return held.select(F.transform("w", lambda x: x["bits"]).alias("filter"))


def bloom_holds(key: Column, held: DataFrame, words: int, level: int) -> Column:
    """Whether the filter may hold the key."""
    bits, out = held.scalar(), F.lit(True)
    for spot in _bits(key, words, level):
        out = out & (F.getbit(F.get(bits, F.floor(spot / 64).cast("int")), F.pmod(spot, F.lit(64)).cast("int")) == 1)
    return out
