"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Benchmark words are numbered, and windows of consecutive words become patterns of numbers of two digits each, from two
alphabets, so that no node has many children and no match begins amid a number.  A document is normalised the same way
(A-Z lower-cased, runs of letters and digits; words of no benchmark item are blanks) and its numbers run through the
automaton once, whatever the number of patterns; stretches of known words that are shorter than any pattern are passed
over.  Matches come as word numbers and, for `contamination_spans`, are mapped back to character offsets of the
original text.

Scale: the scan is a map over the documents with no shuffle.  An automaton has at most `block_nodes` nodes (about 100
bytes each, two for a word of a pattern), so its memory has a bound.  A benchmark beyond that is scanned in further
passes over the source, one automaton each; nothing is rewritten: the passes give hits by a hash of the text, and only
those are joined with the rows.  Long items are cut into sections that overlap by a window.

Cases: a null or empty text has no words, no hits and an empty item list.  Texts and items of any length are read
whole.  Items with no words give no window; one shorter than a window is one.  Repeated documents each get their row;
repeated items count once by id, and an item without an id counts as ''.  Several items with one window all count.
Extra columns are kept by `drop_contaminated` and ignored elsewhere.  An empty benchmark contaminates nothing; without
documents there are no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD_PATTERN, as_bytes, cut, fresh, sliced, words_of

WINDOW = 10
BLOCK_NODES = 4 << 20
#: Children of a node at most, and a word that no pattern has.
DIGIT = 512
_UNKNOWN = "\x00\x00"

_built: dict[str, tuple] = {}


class WindowIndex:
    """The automaton and, for each pattern, its length in words and the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.codes: dict[bytes, str] = {}
        patterns: dict[str, int] = {}
        self.owners: list[tuple[int, tuple[str] | set[str]]] = []  # mostly one item, which needs no set
        self.automaton = ahocorasick.Automaton()
        for item, text in items:
            words = [self._code(w) for w in words_of(text)]
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if words else 0):
                pattern = "".join(words[k : k + size])
                place = patterns.setdefault(pattern, len(patterns))
                if place == len(self.owners):
                    self.owners.append((size, (item,)))
                    self.automaton.add_word(pattern, place)
                    continue
                had = self.owners[place][1]
                if isinstance(had, set):
                    had.add(item)
                elif item not in had:
                    self.owners[place] = (size, {*had, item})
        if patterns:
            self.automaton.make_automaton()
            self.known = re.compile(rf"[^\x00]{{{2 * min(size for size, _ in self.owners)},}}")

    def _code(self, word: bytes) -> str:
        code = self.codes.get(word)
        if code is None:
            high, low = divmod(len(self.codes), DIGIT)
            code = self.codes[word] = chr(0x10000 + high) + chr(0x1000 + low)
        return code

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[str] | set[str]]]:
        """(first word, word after the last, items) of every window occurrence."""
        if not words or not self.owners:
            return []
        code = self.codes.get
        flat = "".join([code(w, _UNKNOWN) for w in words])
        out = []
        for m in self.known.finditer(flat):
            for end, k in self.automaton.iter(flat, m.start(), m.end()):
                stop = (end + 1) // 2
                out.append((stop - self.owners[k][0], stop, self.owners[k][1]))
        return out

    def hits(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """Flat word ranges (first, after the last) of each item, and the item of each range."""
        spots: dict[str, list[tuple[int, int]]] = {}
        for start, stop, items in self.scan(words):
            for item in items:
                spots.setdefault(item, []).append((start, stop))
        ranges: list[int] = []
        owners: list[str] = []
        for item in sorted(spots):
            for start, stop in merged(spots[item]):
                ranges += [start, stop]
                owners.append(item)
        return ranges, owners


def _index(key: str, items: list[tuple[str, bytes]], window: int) -> WindowIndex:
    """One index for each Python worker; an earlier block's goes first."""
    if key not in _built:
        _built.clear()
        _built[key] = (WindowIndex(items, window),)
    return _built[key][0]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges united, in order."""
    out: list[tuple[int, int]] = []
    for first, stop in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((first, stop))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_nodes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks whose automata have at most `block_nodes` nodes; the driver holds one at a time."""
    block: list[tuple[str, bytes]] = []
    size, longest = 0, max(window, block_nodes // (2 * window))
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("binary"))
    for item, body in rows.filter(F.col(text).isNotNull()).toLocalIterator():
        words = words_of(bytes(body))
        for at in range(0, max(1, len(words) - window + 1), max(1, longest - window + 1)):
            section = words[at : at + longest]
            if block and size + 2 * len(section) * window > block_nodes:
                yield block
                block, size = [], 0
            block.append((item, b" ".join(section)))
            size += 2 * len(section) * window
    yield block


def _with_hits(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, block_nodes: int, keep: list[str] | None = None):
    """The documents (or some of their columns) with flat word ranges, the items of each range and the number of words."""
    ranges, owners, count, high, low = fresh(docs, "hit_ranges", "hit_items", "word_count", "text_high", "text_low")
    keep = docs.columns if keep is None else keep
    kept = [f for f in docs.schema.fields if f.name in keep]
    hit_fields = [T.StructField(ranges, T.ArrayType(T.IntegerType())), T.StructField(owners, T.ArrayType(T.StringType()))]
    key_fields = [T.StructField(high, T.LongType()), T.StructField(low, T.LongType())]
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_id, item_text, window, block_nodes)
    block, after = next(blocks), next(blocks, None)

    def index_of(block):
        return spark.sparkContext.broadcast(block), hashlib.md5(repr(block).encode()).hexdigest()

    def kept_columns(batch):
        return [batch.column(f.name) for f in kept]

    if after is None:
        shipped, key = index_of(block)
        schema = T.StructType([*kept, *hit_fields, T.StructField(count, T.LongType())])

        def scan(batches):
            for batch in sliced(batches):
                index = _index(key, shipped.value, window)
                words = [words_of(body) for body in as_bytes(batch.column(text))]
                found = [index.hits(w) for w in words]
                columns = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array(map(len, words), pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept_columns(batch), *columns], names=schema.names)

        return docs.mapInArrow(scan, schema), ranges, owners, count

    def text_keys(bodies):
        keys = [hashlib.blake2b(b or b"", digest_size=16).digest() for b in bodies]
        return [pa.array([int.from_bytes(k[at : at + 8], "little", signed=True) for k in keys], pa.int64()) for at in (0, 8)]

    found = []
    hit_schema = T.StructType([*key_fields, *hit_fields])
    while block is not None:
        shipped, key = index_of(block)

        def scan_block(batches, shipped=shipped, key=key):
            for batch in sliced(batches):
                index, bodies = _index(key, shipped.value, window), as_bytes(batch.column(text))
                hits = [(body, *index.hits(words_of(body))) for body in bodies]
                hits = [h for h in hits if h[1]]
                columns = [*text_keys([h[0] for h in hits]), pa.array([h[1] for h in hits], pa.list_(pa.int32())), pa.array([h[2] for h in hits], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=hit_schema.names)

        # copies of a text have the same hits
        once = docs.select(text).mapInArrow(scan_block, hit_schema).groupBy(high, low).agg(F.first(ranges).alias(ranges), F.first(owners).alias(owners))
        found.append(cut(once, "decontaminate"))
        block, after = after, next(blocks, None)
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    # a row for each block at most
    hits = hits.groupBy(F.col(high).alias("h2"), F.col(low).alias("l2")).agg(F.collect_list(F.struct(F.col(ranges).alias("r"), F.col(owners).alias("o"))).alias("both"))
    hits = hits.select("h2", "l2", F.flatten("both.r").alias("r2"), F.flatten("both.o").alias("o2"))
    schema = T.StructType([*kept, *key_fields, T.StructField(count, T.LongType())])

    def tagged(batches):
        for batch in sliced(batches):
            bodies = as_bytes(batch.column(text))
            counts = pa.array([len(words_of(b)) for b in bodies], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept_columns(batch), *text_keys(bodies), counts], names=schema.names)

    h2, l2, r2, o2 = fresh(docs, "hit_high", "hit_low", "hit_r", "hit_o")
    hits = hits.toDF(h2, l2, r2, o2)
    frame = docs.mapInArrow(tagged, schema).join(hits, (F.col(high) == F.col(h2)) & (F.col(low) == F.col(l2)), "left")
    frame = frame.withColumns({ranges: F.coalesce(r2, F.array().cast("array<int>")), owners: F.coalesce(o2, F.array().cast("array<string>"))})
    return frame.select(*(f.name for f in kept), ranges, owners, count), ranges, owners, count


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, block_nodes=BLOCK_NODES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (distinct, sorted), contaminated."""
    frame, ranges, owners, count = _with_hits(docs.select(doc_id, text), benchmark, text, item_id, item_text, window, block_nodes, [doc_id])
    schema = T.StructType([docs.schema[doc_id]] + [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.StringType())), ("contaminated", T.BooleanType()))])

    def summed(batches):
        for batch in sliced(batches):
            hits, items = [], []
            for flat, whose in zip(batch.column(ranges).to_pylist(), batch.column(owners).to_pylist()):
                hits.append(sum(stop - start for start, stop in merged(list(zip(flat[::2], flat[1::2])))))
                items.append(sorted(set(whose)))
            yield pa.RecordBatch.from_arrays([
                batch.column(doc_id), batch.column(count), pa.array(hits, pa.int64()), pa.array(map(len, items), pa.int64()),
                pa.array(items, pa.list_(pa.string())), pa.array([h > 0 for h in hits], pa.bool_())], names=schema.names)

    return frame.mapInArrow(summed, schema)


def contamination_spans(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, block_nodes=BLOCK_NODES) -> DataFrame:
    """One row per hit passage and item: doc_id, item_id, start, stop (code points of the original), passage."""
    frame, ranges, owners, _ = _with_hits(docs.select(doc_id, text), benchmark, text, item_id, item_text, window, block_nodes)
    frame = frame.filter(F.size(ranges) > 0)
    schema = T.StructType([docs.schema[doc_id], T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("passage", T.StringType())])
    word = re.compile(WORD_PATTERN)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def spans(batches):
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc, body, flat, whose in zip(*(batch.column(c).to_pylist() for c in (doc_id, text, ranges, owners))):
                if flat:
                    at = [m.span() for m in word.finditer(body.translate(lower))]
                    spots: dict[str, list[tuple[int, int]]] = {}
                    for item, start, stop in zip(whose, flat[::2], flat[1::2]):
                        spots.setdefault(item, []).append((start, stop))
                    for item in sorted(spots):
                        for start, stop in merged(spots[item]):
                            a, b = at[start][0], at[stop - 1][1]
                            out.append((doc, item, a, b, body[a:b]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [batch.schema.field(doc_id).type, pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return frame.mapInArrow(spans, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", window=WINDOW, block_nodes=BLOCK_NODES) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    frame, ranges, _, _ = _with_hits(docs, benchmark, text, item_id, item_text, window, block_nodes)
    return frame.filter(F.size(ranges) == 0).select(*docs.columns)
