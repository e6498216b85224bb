"""An inverted index with block maxima, and exact top-k search by dynamic pruning.

The index is made by a map, without a shuffle: a task turns the documents it reads into shards of bounded size.  In a
shard documents are numbered by length, then position; each term has one row with delta-coded document numbers, term
frequencies and, for each block (its postings among 64 neighbouring numbers), the best share of a score that a posting
of the block can give.  One more row of a shard, without a term, has its documents' keys, positions and lengths.  Rows
are sorted by term, so files can be skipped by term; term statistics come from the index without reading postings.

A search takes only the rows of the terms asked for (a semi-join with a broadcast of bounded size) to their shards and
works shard by shard, each a bounded group.  For a query, block maxima give bounds in three steps, none of which can
lose a document: of 64 neighbours, from blocks alone; of a document, from the blocks of the lists it is in; and then the
exact score.  Neighbourhoods are visited by bound, so that the k-th best score rises soon, and what can't reach it is
neither decoded further nor scored.  Each shard hands on k rows a query.

Shards are cut by documents rather than terms: what a query's lists have to be joined by is then at hand in one place,
and a term that stands in every document is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.staging import staged

K1, B = 1.5, 0.75
#: Ranks compare scores at this many decimals, so that the order of a distributed sum can't flip a tie.
RANK_DECIMALS = 9
#: Documents of a block, and documents and tokens at which a shard is closed.
NEIGHBOURS = 64
SHARD_DOCUMENTS = 16_384
SHARD_TOKENS = 2 << 20
#: What a bound may miss by rounding; ranks compare scores at 9 decimals.
SLACK = 1e-8


def gain(tf: np.ndarray, length: np.ndarray, mean_length: float) -> np.ndarray:
    """What a term adds to a BM25 score for each unit of its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def _schema(key: T.DataType) -> T.StructType:
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    return T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("deltas", ints), T.StructField("tfs", ints), T.StructField("counts", ints), T.StructField("maxima", T.ArrayType(T.FloatType())),
        T.StructField("positions", longs), T.StructField("keys", T.ArrayType(key)), T.StructField("lengths", ints)])


def _list(values: np.ndarray, starts: np.ndarray, more: int = 0) -> pa.Array:
    """A list column; `more` empty lists follow."""
    ends = np.concatenate([starts, np.full(more, starts[-1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def shard_rows(tokens: pa.ListArray, positions: np.ndarray, keys: pa.Array, shard: int, schema: T.StructType) -> pa.RecordBatch:
    """The rows of one shard: its terms in order, then its documents."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((positions, lengths))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    words = tokens.flatten().dictionary_encode()
    alphabet = words.dictionary
    place = np.empty(len(alphabet), np.int64)
    place[pc.sort_indices(alphabet).to_numpy()] = np.arange(len(alphabet))
    terms = alphabet.take(pa.array(np.argsort(place)))
    document = np.repeat(number, lengths)
    pair, tf = np.unique(place[words.indices.to_numpy(zero_copy_only=False)] * len(order) + document, return_counts=True) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    term, document = np.divmod(pair, max(1, len(order)))
    sorted_lengths = lengths[order]
    mean = max(1.0, float(lengths.mean())) if len(lengths) else 1.0
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    deltas = np.diff(document, prepend=0)
    deltas[first[:-1]] = document[first[:-1]]
    begins = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(document // NEIGHBOURS, prepend=-1) != 0))
    best = np.maximum.reduceat(gain(tf, sorted_lengths[document], mean), begins) if len(begins) else np.zeros(0)
    maxima = np.nextafter(best.astype(np.float32), np.float32(np.inf))
    blocks = np.searchsorted(begins, first)
    n, rows = len(terms), len(terms) + 1
    arrow = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    columns = {
        "shard": pa.array(np.full(rows, shard)), "term": pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())]),
        "n": pa.array(np.append(np.diff(first), len(order))), "length": pa.array(np.append(np.zeros(n, np.int64), lengths.sum())),
        "deltas": _list(deltas.astype(np.int32), first, 1), "tfs": _list(tf.astype(np.int32), first, 1),
        "counts": _list(np.diff(np.append(begins, len(term))).astype(np.int32), blocks, 1), "maxima": _list(maxima, blocks, 1),
        "positions": _list(positions[order], np.append(np.zeros(rows), len(order))), "lengths": _list(sorted_lengths.astype(np.int32), np.append(np.zeros(rows), len(order))),
        "keys": pa.ListArray.from_arrays(pa.array(np.append(np.zeros(rows), len(order)).astype(np.int32)), keys.take(pa.array(order)))}
    return pa.RecordBatch.from_arrays([columns[name].cast(t) for name, t in arrow.items()], names=schema.names)


def build_index(corpus: DataFrame, key: str, pos: str, tokens: str = "tokens", documents: int = SHARD_DOCUMENTS, most_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The index of a corpus (key, pos (an integer), tokens); see the module for its rows."""
    schema = _schema(corpus.schema[key].dataType)

    def build(batches: Iterator[pa.RecordBatch]):
        held, rows, size, shards = [], 0, 0, TaskContext.get().partitionId() << 32

        def closed():
            whole = pa.Table.from_batches(held).combine_chunks()
            column = [whole.column(k).chunk(0) for k in range(3)]
            return shard_rows(column[2], column[1].to_numpy(zero_copy_only=False), column[0], shards, schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                rows += part.num_rows
                size += int(pc.sum(pc.list_value_length(part.column(2))).as_py() or 0)
                if rows >= documents or size >= most_tokens:
                    yield closed()
                    held, rows, size, shards = [], 0, 0, shards + 1
        if held:
            yield closed()

    return corpus.select(F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(tokens).alias("tokens")).mapInArrow(build, schema)


def index_statistics(index: DataFrame) -> DataFrame:
    """term, df, length: documents of each term; the null term has the number of documents and of all their tokens."""
    return index.groupBy("term").agg(F.sum("n").alias("df"), F.sum("length").alias("length"))


@dataclass
class Shard:
    """What a search needs of a shard: its documents, and the postings and blocks of the terms asked for."""

    positions: np.ndarray
    keys: pa.Array
    lengths: np.ndarray
    document: np.ndarray  # of each posting
    tf: np.ndarray
    begin: np.ndarray  # of each block in the postings
    end: np.ndarray
    maxima: np.ndarray
    blocks: dict  # number of a term -> slice of its blocks

    @staticmethod
    def of(table: pa.Table, terms: pa.Array) -> Shard | None:
        rows = table.combine_chunks()
        is_term = pc.is_valid(rows.column("term"))
        about = rows.filter(pc.invert(is_term))
        if not about.num_rows:
            return None
        rows = rows.filter(is_term)
        flat = lambda t, c, kind: (t.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)).astype(kind, copy=False)
        sizes = lambda c: (pc.list_value_length(rows.column(c)).to_numpy() if rows.num_rows else np.zeros(0)).astype(np.int64)
        deltas, n = flat(rows, "deltas", np.int64), sizes("deltas")
        sums = np.cumsum(deltas)
        first = np.cumsum(n) - n
        base = sums[first] - deltas[first] if len(n) else np.zeros(0, np.int64)
        counts, per_term = flat(rows, "counts", np.int64), sizes("counts")
        ends, last = np.cumsum(counts), np.cumsum(per_term)
        number = pc.index_in(rows.column("term"), value_set=terms).to_pylist()
        blocks = {t: slice(int(b - k), int(b)) for t, b, k in zip(number, last, per_term)}
        mean = max(1.0, float(flat(about, "lengths", np.float64).mean())) if len(flat(about, "lengths", np.float64)) else 1.0
        shard = Shard(flat(about, "positions", np.int64), about.column("keys").chunk(0).flatten(), flat(about, "lengths", np.int64), sums - np.repeat(base, n), flat(rows, "tfs", np.int64), ends - counts, ends, flat(rows, "maxima", np.float64), blocks)
        shard.mean = mean
        return shard

    def search(self, terms: np.ndarray, weights: np.ndarray, mean_length: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and scores of the k best documents, best first, and how many documents were scored.

        terms: numbers of the query's terms; weights: what their gain is multiplied by, which may be negative.
        """
        here = [(self.blocks[t], w) for t, w in zip(terms.tolist(), weights.tolist()) if t in self.blocks]
        if here:
            found = self._pruned(here, mean_length, k)
            if found is not None:
                return found
        # fewer than k documents score above 0, so those without a hit count
        scores, scored = np.zeros(len(self.lengths)), np.zeros(len(self.lengths), bool)
        for blocks, w in here:
            if blocks.stop > blocks.start:
                p = slice(int(self.begin[blocks.start]), int(self.end[blocks.stop - 1]))
                d = self.document[p]
                scores[d] += w * gain(self.tf[p], self.lengths[d], mean_length)
                scored[d] = True
        order = np.lexsort((self.positions, -np.round(scores, RANK_DECIMALS)))[:k]
        return order, scores[order], int(scored.sum())

    def _pruned(self, here, mean_length: float, k: int):
        # maxima were taken under the shard's mean length; a longer mean raises a gain by its ratio at most
        slope = max(1.0, mean_length / self.mean)
        block = np.concatenate([np.arange(b.start, b.stop) for b, _ in here])
        weight = np.concatenate([np.full(b.stop - b.start, w) for b, w in here])
        bound = self.maxima[block] * np.maximum(weight, 0) * slope
        hood = self.document[self.begin[block]] // NEIGHBOURS
        reach = np.bincount(hood, bound)
        order = np.argsort(-reach, kind="stable")
        by_hood = np.argsort(hood, kind="stable")
        first = np.searchsorted(hood[by_hood], np.arange(len(reach) + 1))
        best_d, best_s, least, scored, at, step = np.zeros(0, np.int64), np.zeros(0), SLACK, 0, 0, 2
        while at < len(order) and reach[order[at]] >= least:
            hoods = order[at : at + step]
            at, step = at + step, min(4 * step, 4096)
            hoods = hoods[reach[hoods] >= least]
            some = by_hood[_ranges(first[hoods], first[hoods + 1])]
            sizes = self.end[block[some]] - self.begin[block[some]]
            posting = _ranges(self.begin[block[some]], self.end[block[some]])
            document, owner = self.document[posting], np.repeat(some, sizes)
            seen, local = np.unique(document, return_inverse=True)
            limit = np.bincount(local, bound[owner])
            # the most promising ones first, so that the rest meets a higher bar
            lead = np.zeros(len(seen), bool)
            lead[np.argsort(-limit, kind="stable")[: 2 * k]] = True
            for group in (lead, ~lead):
                wanted = group & (limit >= least)
                if not wanted.any():
                    continue
                scored += int(wanted.sum())
                p = np.flatnonzero(wanted[local])
                score = np.bincount(local[p], weight[owner[p]] * gain(self.tf[posting[p]], self.lengths[document[p]], mean_length), len(seen))
                d, s = np.concatenate([best_d, seen[wanted]]), np.concatenate([best_s, score[wanted]])
                top = np.lexsort((self.positions[d], -np.round(s, RANK_DECIMALS)))[:k]
                best_d, best_s = d[top], s[top]
                if len(top) == k:
                    least = max(SLACK, float(best_s[-1]) - SLACK)
        if len(best_s) < k or np.round(best_s[-1], RANK_DECIMALS) <= 0:
            return None
        return best_d, best_s, scored


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - begins
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


def search_index(index: DataFrame, weights, query: str, query_type: T.DataType, k: int) -> DataFrame:
    """query, key, best_pos, bm25_score: the k best documents of each shard for each query of `weights`.

    A row without best_pos says of a shard how many (query, document) pairs there were and how many were scored.
    """
    key = index.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(query, query_type), T.StructField("key", key), T.StructField("best_pos", T.LongType()), T.StructField("bm25_score", T.DoubleType()), T.StructField("pairs", T.LongType()), T.StructField("scored", T.LongType())])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    spark = index.sparkSession
    shipped = spark.sparkContext.broadcast(weights)
    asked = spark.createDataFrame([(t,) for t in weights.terms.to_pylist()], "term string")
    rows = index.filter("term IS NULL").unionByName(index.filter("term IS NOT NULL").join(F.broadcast(asked), "term", "left_semi"))

    def search(table: pa.Table) -> pa.Table:
        w = shipped.value
        shard = Shard.of(table, w.terms)
        names, documents, scores, pairs, scored = [], [], [], 0, 0
        for q, (terms, own) in enumerate(w.by_query()) if shard else ():
            d, s, n = shard.search(terms, own, w.mean_length, k)
            pairs, scored = pairs + len(shard.lengths), scored + n
            names.append(np.full(len(d), q))
            documents.append(d)
            scores.append(s)
        q = np.concatenate(names) if names else np.zeros(0, np.int64)
        d = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        s = np.concatenate(scores) if scores else np.zeros(0)
        none = [None] * len(q)
        columns = [
            [*(w.names[j] for j in q.tolist()), None], [*(shard.keys.take(pa.array(d)).to_pylist() if shard else ()), None], [*(shard.positions[d].tolist() if shard else ()), None],
            [*s.tolist(), None], [*none, pairs], [*none, scored]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=schema.names)

    return rows.groupBy("shard").applyInArrow(search, schema)


def stored_index(corpus: DataFrame, key: str, pos: str, **options) -> DataFrame:
    return staged(build_index(corpus, key, pos, **options), "postings")
