"""Token-ID output: best-fit-decreasing packing of documents into rows of fixed length.

A document's ids are cut into pieces of at most `length` (every id once, in order).  Within a block of about
`block_tokens` ids, pieces go longest first into the open row whose free capacity is the smallest that
holds them; a segment tree over capacities finds it in O(log length).  Each packed row has its ids as
little-endian integers padded to `length`, cumulative segment lengths, the positions at which position ids
restart from 0, and the document and first token of every segment, so texts can be restored exactly.

Scale: a map with no shuffle.  Blocks fill from a partition's stream, so memory is bounded by
`block_tokens`, not by the partition or by a source; only the last row of a block is likely to be loose.

Cases: a null or empty text has no ids and takes no place.  A text longer than a block is cut as it comes; runs of
any length of one character are encoded.  Pieces of equal length keep their order, and of equally full rows the last
opened is taken.  Repeated rows are packed each; a null doc_id is carried as null.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokenizer import DEFAULT_VOCABULARY, encode, encoding, read_vocabulary, vocabulary_size

LENGTH = 2048
BLOCK_TOKENS = 2 << 20


class CapacityTree:
    """Counts of open rows by free capacity, as a segment tree; finds the tightest fit."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        k = self.size + capacity
        while k:
            self.counts[k] += by
            k >>= 1

    def least_at_least(self, need: int) -> int | None:
        """The smallest capacity of an open row that is `need` or more."""
        counts, k = self.counts, self.size + need
        if not counts[k]:
            while k > 1 and (k & 1 or not counts[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if counts[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows as lists of piece numbers; no row's pieces exceed `length`."""
    tree, open_rows, rows = CapacityTree(length), [[] for _ in range(length + 1)], []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[piece]
        capacity = tree.least_at_least(need)
        if capacity is None:
            row, capacity = len(rows), length
            rows.append([])
        else:
            row = open_rows[capacity].pop()
            tree.add(capacity, -1)
        rows[row].append(piece)
        if capacity > need:
            open_rows[capacity - need].append(row)
            tree.add(capacity - need, 1)
    return rows


def pack_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, length=LENGTH, block_tokens=BLOCK_TOKENS, doc_id="doc_id", text="text", pad_id: int | None = None) -> DataFrame:
    """Packed rows: shard, block, row, n_tokens, input_ids (binary, uint16 or uint32), cu_seqlens,
    position_resets, doc_ids, token_starts."""
    data = read_vocabulary(vocabulary)
    size = vocabulary_size(data)
    pad = size if pad_id is None else pad_id
    dtype = np.dtype("<u2" if max(size, pad + 1) <= 1 << 16 else "<u4")
    shipped = docs.sparkSession.sparkContext.broadcast(data)
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("shard", "block", "row", "n_tokens")] + [
        T.StructField("input_ids", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(docs.schema[doc_id].dataType)), T.StructField("token_starts", T.ArrayType(T.LongType()))])

    def packed(shard: int, block: int, pieces: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            matrix = np.full((len(some), length), pad, dtype)
            ends, resets, whose, starts, filled = [], [], [], [], []
            for k, row in enumerate(some):
                bounds = [0]
                for piece in row:
                    ids = pieces[piece][2]
                    matrix[k, bounds[-1] : bounds[-1] + len(ids)] = ids
                    bounds.append(bounds[-1] + len(ids))
                ends.append(bounds)
                resets.append(bounds[:-1])
                whose.append([pieces[p][0] for p in row])
                starts.append([pieces[p][1] for p in row])
                filled.append(bounds[-1])
            n = len(some)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(at, at + n), pa.int32()), pa.array(filled, pa.int32()),
                pa.array([line.tobytes() for line in matrix], pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())),
                pa.array(whose, pa.list_(kind)), pa.array(starts, pa.list_(pa.int64()))], names=schema.names)

    def run(batches):
        coder, shard = encoding(shipped.value), TaskContext.get().partitionId()
        pieces, held, block, kind = [], 0, 0, None
        for batch in batches:
            kind = batch.schema.field(doc_id).type
            for doc, body in zip(batch.column(doc_id).to_pylist(), batch.column(text)):
                ids = np.array(encode(coder, body.as_py()), dtype) if body.is_valid else ()
                for start in range(0, len(ids), length):
                    pieces.append((doc, start, ids[start : start + length]))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        yield from packed(shard, block, pieces, kind)
                        pieces, held, block = [], 0, block + 1
        if pieces:
            yield from packed(shard, block, pieces, kind)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def unpack(rows: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> dict:
    """Texts by document from packed rows, for round trips over small tables: the inverse of packing."""
    data = read_vocabulary(vocabulary)
    dtype = "<u2" if vocabulary_size(data) + 1 <= 1 << 16 else "<u4"
    parts: dict = {}
    for r in rows.collect():
        ids = np.frombuffer(r["input_ids"], dtype)
        for doc, start, a, b in zip(r["doc_ids"], r["token_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    return {doc: encoding(data).decode([i for _, ids in sorted(found) for i in ids]) for doc, found in parts.items()}


def write_packed(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet under `path`, by shard; matrices are the input_ids of a block's rows in order."""
    rows.write.mode("overwrite").parquet(path)
