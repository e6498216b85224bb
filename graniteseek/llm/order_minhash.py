"""Near-dedup with Order MinHash, verified by banded alignment.

Words are a text's runs of letters and digits, A-Z lower-cased.  Every run of three words is a k-mer (of two
in texts of up to 64 words; texts that may be similar to such have both), labelled by how often it occurred before.  Each of `sketches` hash functions picks the `picks` labelled k-mers with the
smallest values and keeps them in text order; equal ordered picks make a candidate.  As the picks keep their order,
agreement follows edit similarity, not only shared content.  A candidate becomes a link if the edit distance of the
word sequences is at most (1 - similarity) of the longer one, computed in a diagonal band that grows until it
decides.  Texts under a k-mer's words have one k-mer, the whole text.

Scale: texts with the same words (a 128-bit hash) are one class from the start, so exact copies cost an aggregation.
Classes are numbered, and sketch keys (a few hundred bytes a class) are shuffled with those numbers, not texts: once
to find the keys that several classes have and once to gather them.  In a bucket every class is a candidate with the
bucket's first one.  Each class is verified against the first that heads most of its buckets, then against those firsts
it isn't yet connected to.  What isn't connected to the first of its bucket is then compared with all other members,
the connected ones included, in bands of length (texts more than a band apart can't be similar) and within them in
blocks of bounded size.  Only exact bounds (lengths, shared words) spare a pair of different components its alignment,
and what a block links is one component at once.  So a group of thousands of near copies gives as many candidates, not
their square.  Distinct texts move once, those in a bucket again for each verification.  Joins that grow with the
documents are shuffle joins at every size.  Components are contracted on DataFrames; nothing about documents is
collected.  Scratch tables are deleted as soon as all that read them is written.

Cases: a null text is a class of its own kind: it links with nothing and is kept.  Empty texts and texts without a
word are alike only if equal byte for byte.  Texts of any length are read whole; memory is one text and its k-mers.
Repeated rows are copies.  One row of a group is kept: that with the least doc_id, a null one last, and of several
rows with that id the first written.  A group of null ids has a null class_id.  Sketch ties don't arise: repeats of
a k-mer are labelled.  An empty table gives an empty one.  Extra columns are ignored by `near_duplicates` and kept by
`drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import as_bytes, cut, free, fresh, sliced, words_of

SHINGLE = 3
SKETCHES = 60
#: Texts of up to SHORT words have k-mers of SHORT_SHINGLE words; those that may be similar to longer ones have both.
SHORT = 64
SHORT_SHINGLE = 2
PICKS = 2
SIMILARITY = 0.8
BLOCK = 2048
BLOCK_WORDS = 1 << 21
PROFILE = 256
#: Bytes of text that are hashed at once, and the longest word hashed with others.
STRETCH = 1 << 16
LONG_WORD = 256

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs, others look random."""
    y = x >> np.uint64(30)
    y ^= x
    y *= _MIX[0]
    y ^= y >> np.uint64(27)
    y *= _MIX[1]
    y ^= y >> np.uint64(31)
    return y


def _seeds(sketches: int) -> np.ndarray:
    return _mixed(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(LONG_WORD - 1, 0x9E3779B97F4A7C15, np.uint64))))
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX[0])
_BYTES[32] = 0


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, a stretch of the text at a time: sums of their bytes' numbers times powers of an odd one.

    Words longer than those powers reach are hashed one by one.
    """
    if not words:
        return np.zeros(0, np.uint64)
    flat = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(flat == 32) + 1))
    ends = np.append(starts[1:], len(flat) + 1)
    out = np.empty(len(words), np.uint64)
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STRETCH, "right")))
        at = starts[first:last] - starts[first]
        some = flat[starts[first] : ends[last - 1]]
        offset = np.arange(len(some)) - np.repeat(at, np.diff(np.append(at, len(some))))
        out[first:last] = np.add.reduceat(_BYTES[some] * _POWERS[np.minimum(offset, LONG_WORD - 1)], at)
        first = last
    out = _mixed(out)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(words[k], digest_size=8).digest(), "little")
    return out


def labelled_kmers(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the k-mers, each with the number of its earlier places mixed in."""
    n = max(1, len(words) - size + 1)
    x = np.full(n, np.uint64(len(words) if len(words) < size else size))
    for j in range(min(size, len(words))):
        x = _mixed(x * np.uint64(3) + words[j : j + n])
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if len(starts) == n:
        return x
    earlier = np.empty(n, np.uint64)
    earlier[order] = np.arange(n) - np.repeat(starts, np.diff(np.concatenate((starts, [n]))))
    return np.where(earlier > 0, _mixed(x + earlier), x)


def order_minhash(kmers: np.ndarray, seeds: np.ndarray, picks: int = PICKS) -> np.ndarray:
    """One key for each seed: the hash of its smallest k-mers in text order."""
    picks = min(picks, len(kmers))
    keys = np.empty(len(seeds), np.uint64)
    step = max(1, (1 << 15) // len(kmers))  # blocks that stay in a core's cache
    for at in range(0, len(seeds), step):
        values = _mixed(kmers[None, :] ^ seeds[at : at + step, None])
        lines = np.arange(len(values))
        chosen = np.empty((len(values), picks), np.int64)
        for k in range(picks):  # the smallest, then the smallest of the rest
            chosen[:, k] = values.argmin(1)
            values[lines, chosen[:, k]] = np.iinfo(np.uint64).max
        chosen.sort(1)
        key = seeds[at : at + step].copy()
        for k in range(picks):
            key = _mixed(key * np.uint64(3) + kmers[chosen[:, k]])
        keys[at : at + step] = key
    return keys


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`; bands double until one decides."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a) if len(a) <= most else None
    places: dict[int, list[int]] = {}
    for k, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(k)
    columns, band = b.tolist(), max(8, len(a) - len(b))
    while len(a) - len(b) <= most:
        d = _banded(len(a), places, columns, min(band, most))
        if d is not None:
            return d
        if band >= most:
            return None
        band *= 2
    return None


def _banded(rows: int, places: dict[int, list[int]], columns: list[int], width: int) -> int | None:
    """Edit distance over cells at most `width` off the diagonal, if it is at most `width`.

    Bit k of column j stands for row j - width + k, so a diagonal keeps its bit; each column is a few operations
    on integers of 2 * width + 1 bits (vertical differences +1 and -1, as in bit-parallel alignment).  The end
    cell's diagonal is followed; distances never fall along it, which allows an early end.
    """
    full = (1 << (2 * width + 1)) - 1
    plus, minus = full ^ ((1 << (width + 1)) - 1), 0
    distance, top = rows - len(columns), 1 << (2 * width)
    follow = 1 << (width + distance)
    if distance > width:
        return None
    chunk = max(256, width)
    for begin in range(0, len(columns), chunk):
        base = begin - width  # row index (from 0) of bit 0 in the chunk's first column
        last = base + 2 * width + chunk
        masks: dict[int, int] = {}
        for j in range(begin, min(begin + chunk, len(columns))):
            x = columns[j]
            mask = masks.get(x)
            if mask is None:
                mask, at = 0, places.get(x)
                if at:
                    for p in at[bisect_left(at, base) : bisect_right(at, last)]:
                        mask |= 1 << (p - base)
                masks[x] = mask
            mask = (mask >> (j - begin)) & full
            plus = plus >> 1 | top
            minus >>= 1
            x = mask | minus
            zero = ((plus + (x & plus)) ^ plus | x) & full
            down = plus & zero
            up = (minus | ~(plus | zero)) & full
            x = (up << 1 | 1) & full
            minus = x & zero
            plus = (down << 1 | ~(x | zero)) & full
            if not zero & follow:
                distance += 1
                if distance > width:
                    return None
    return distance


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most 1 - similarity of the longer sequence."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and edit_distance_within(a, b, most) is not None


def class_key(words: list[bytes], body: bytes) -> tuple[int, int]:
    """128 bits of the text's words, or of its bytes if it has none."""
    data = hashlib.blake2b(b" ".join(words) if words else b"\x00" + body, digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def _class_keys(bodies: list[bytes | None]) -> tuple[pa.Array, pa.Array]:
    keys = [(None, None) if b is None else class_key(words_of(b), b) for b in bodies]
    return pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())


def sketch_keys(words: np.ndarray, seeds: np.ndarray, picks: int = PICKS, size: int = SHINGLE, similarity: float = SIMILARITY) -> np.ndarray:
    """The keys of the long k-mers, then those of the short ones; zeros for those that the length rules out."""
    keys = np.zeros(2 * len(seeds), np.uint64)
    if len(words) > SHORT:
        keys[: len(seeds)] = order_minhash(labelled_kmers(words, size), seeds, picks)
    if len(words) and len(words) * similarity <= SHORT + 1e-6:
        keys[len(seeds) :] = order_minhash(labelled_kmers(words, min(size, SHORT_SHINGLE)), seeds, picks)
    return keys


def _keyed(docs: DataFrame, doc_id: str, text: str, sketches: int, picks: int, size: int, similarity: float) -> DataFrame:
    """id, hi, lo (the class; null for a null text), n_words, keys (empty without words) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        seeds = _seeds(sketches)
        for batch in sliced(batches):
            hi, lo, counts, keys = [], [], [], []
            for body in as_bytes(batch.column(text)):
                words = words_of(body)
                key = (None, None) if body is None else class_key(words, body)
                hi.append(key[0])
                lo.append(key[1])
                counts.append(len(words))
                keys.append(sketch_keys(word_hashes(words), seeds, picks, size, similarity).view(np.int64) if words else [])
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs (a, b) whose texts are similar."""
    texts_a, texts_b = bodies.toDF("ca", "ta"), bodies.toDF("cb", "tb")
    joined = pairs.join(texts_a.hint("merge"), F.col("a") == F.col("ca")).select("a", "b", "ta")
    joined = joined.join(texts_b.hint("merge"), F.col("b") == F.col("cb")).select("a", "b", "ta", "tb")

    def run(batches):
        for batch in sliced(batches):
            keep, last, had = [], None, None
            for ta, tb in zip(as_bytes(batch.column("ta")), as_bytes(batch.column("tb"))):
                if tb != last:
                    last, had = tb, word_hashes(words_of(tb))
                keep.append(similar(word_hashes(words_of(ta)), had, similarity))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of the classes in links; both are hashes of class numbers, as contraction wants them, which
    64 bits of one number map to one to one."""
    return connected_components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))


def _classes(docs: DataFrame, doc_id: str, text: str, sketches: int, picks: int, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, id, hi, lo) and classes (cls, hi, lo, least, n_words, keys); least: its first row by id, nulls last."""
    keyed = cut(_keyed(docs, doc_id, text, sketches, picks, size, similarity).withColumn("rid", F.monotonically_increasing_id()), "omh-keyed")
    rows = cut(keyed.select("rid", "id", "hi", "lo"), "omh-rows")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("least")
    classes = keyed.filter("hi is not null").groupBy("hi", "lo").agg(least, F.first("n_words").alias("n_words"), F.first("keys").alias("keys"))
    # the number is the class's place in the table as it is written; it is never made again
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "omh-classes")
    free(keyed)
    return rows, classes


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, sketch, cls, n_words, first): the classes of every key that more than one has; first is the least."""
    each = classes.filter(F.size("keys") > 0).select("cls", "n_words", F.posexplode("keys").alias("sketch", "key")).filter("key <> 0")
    each = each.select("cls", "n_words", F.col("sketch").cast("short").alias("sketch"), F.xxhash64("sketch", "key").alias("key"))
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("first")).filter("n > 1").select(F.col("key").alias("bucket"), "first")
    return cut(each.join(several.hint("merge"), F.col("key") == F.col("bucket")).select("bucket", "sketch", "cls", "n_words", "first"), "omh-buckets")


def _links(docs: DataFrame, text: str, classes: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b) links between similar classes that share a bucket, enough of them to connect all such classes."""
    held = _buckets(classes)
    # the texts of all that stands in a bucket, moved once for all verifications
    bodies = _class_texts(docs, text, held.select(F.col("cls").alias("w")).distinct(), classes)
    heads = held.filter("cls = first").select(F.col("cls").alias("h"), F.col("n_words").alias("first_words")).distinct()
    # lengths that far apart can't be similar
    near = F.least("n_words", "first_words") >= F.greatest("n_words", "first_words") * similarity - 1e-6
    stars = held.filter("cls <> first").groupBy("cls", "n_words", "first").agg(F.count(F.lit(1)).alias("n"))
    stars = stars.join(heads.hint("merge"), F.col("first") == F.col("h")).filter(near)
    stars = cut(stars.select(F.col("cls").alias("a"), F.col("first").alias("b"), "n"), "omh-stars")
    # each class first meets the one that heads most of its buckets; what that connects needs no more candidates
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    links = [cut(_verified(best, bodies, similarity), "omh-links")]
    roots = _roots(links[0])
    ra, rb = roots.toDF("na", "ra"), roots.toDF("nb", "rb")
    root_a, root_b = F.coalesce("ra", F.xxhash64("a")), F.coalesce("rb", F.xxhash64("b"))
    others = stars.join(ra, F.xxhash64("a") == F.col("na"), "left").join(rb, F.xxhash64("b") == F.col("nb"), "left").filter(root_a != root_b).select("a", "b")
    others = cut(others.join(best.toDF("ta", "tb"), (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"), "omh-others")
    free(roots)
    links.append(cut(_verified(others, bodies, similarity), "omh-links"))
    free(others, stars)
    # members that aren't connected to the first of their bucket, compared with all its other members
    roots = _roots(links[0].unionByName(links[1]))
    ra, rb = roots.toDF("na", "ra"), roots.toDF("nb", "rb")
    rest = held.filter("cls <> first").join(ra, F.xxhash64("cls") == F.col("na"), "left").join(rb, F.xxhash64("first") == F.col("nb"), "left")
    rest = rest.select("bucket", "sketch", "cls", "n_words", F.coalesce("ra", F.xxhash64("cls")).alias("root"), F.coalesce("rb", F.xxhash64("first")).alias("first_root"))
    open_ = F.col("root") != F.col("first_root")
    many = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(open_, F.col("n_words"))).alias("least"), F.max(F.when(open_, F.col("n_words"))).alias("most")).filter("n > 1 and least is not null")
    many = many.select(F.col("bucket").alias("b2"), "least", "most")
    reachable = (F.col("n_words") >= F.col("least") * similarity - 1e-6) & (F.col("n_words") * similarity <= F.col("most") + 1e-6)
    rest = cut(rest.join(many, F.col("bucket") == F.col("b2")).filter(reachable).select("bucket", "sketch", "cls", "n_words", "root"), "omh-rest")
    free(held, roots)
    links.append(cut(_rest_links(rest, classes, bodies, similarity, block), "omh-links"))
    free(rest, bodies)
    out = cut(links[0].unionByName(links[1]).unionByName(links[2]), "omh-all-links")
    free(*links)
    return out


def _decided(docs: DataFrame, doc_id: str, text: str, sketches=SKETCHES, picks=PICKS, size=SHINGLE, similarity=SIMILARITY, block=BLOCK) -> DataFrame:
    """id, hi, lo, class_id and kept of every row."""
    rows, classes = _classes(docs, doc_id, text, sketches, picks, size, similarity)
    links = _links(docs, text, classes, similarity, block)
    roots = _roots(links)
    free(links)
    members = classes.select("cls", "hi", "lo", "least").join(roots, F.xxhash64("cls") == F.col("node"), "left")
    members = cut(members.select("hi", "lo", "least", F.coalesce("root", F.xxhash64("cls")).alias("root")), "omh-members")
    free(classes, roots)
    firsts = cut(members.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "r2"), "omh-firsts")  # a table, so that a large class can be split in the join
    named = members.join(firsts, F.col("root") == F.col("r2")).select(F.col("hi").alias("h2"), F.col("lo").alias("l2"), "first")
    out = rows.join(named.hint("merge"), (F.col("hi") == F.col("h2")) & (F.col("lo") == F.col("l2")), "left")
    out = cut(out.select("id", "hi", "lo", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept")), "omh-decided")
    free(rows, members, firsts)
    return out


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", sketches=SKETCHES, picks=PICKS, size=SHINGLE, similarity=SIMILARITY, block=BLOCK) -> DataFrame:
    """One row per document row: doc_id, class_id (the least doc_id of its group), kept (one row of each group)."""
    return _decided(docs, doc_id, text, sketches, picks, size, similarity, block).select(F.col("id").alias(doc_id), "class_id", "kept")


def _class_texts(docs: DataFrame, text: str, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, body) of the wanted classes (w), one row each."""
    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*_class_keys(as_bytes(batch.column(text))), batch.column(text)], names=["th", "tl", "body"])

    texts = docs.select(text).filter(F.col(text).isNotNull()).mapInArrow(run, "th long, tl long, body string")
    named = classes.select("cls", "hi", "lo").join(wanted.hint("merge"), F.col("cls") == F.col("w"), "left_semi")
    # one text per class before the shuffle, so that a group of copies isn't gathered; all have the same words
    texts = texts.groupBy("th", "tl").agg(F.first("body").alias("body"))
    return cut(texts.join(named.hint("merge"), (F.col("th") == F.col("hi")) & (F.col("tl") == F.col("lo"))).select("cls", "body"), "omh-texts")


def _profiles(bodies: DataFrame) -> DataFrame:
    """(pc, profile, body): how many words of a text fall into each of PROFILE hash buckets, as 16-bit integers; empty
    for texts whose counts might not fit."""
    def run(batches):
        for batch in sliced(batches):
            found = []
            for words in map(words_of, as_bytes(batch.column("body"))):
                bucket = (word_hashes(words) % np.uint64(PROFILE)).astype(np.int64) if len(words) < 1 << 16 else None
                found.append(b"" if bucket is None else np.bincount(bucket, minlength=PROFILE).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(found, pa.binary()), batch.column("body")], names=["pc", "profile", "body"])

    return bodies.mapInArrow(run, "pc long, profile binary, body string")


def _dealt(rest: DataFrame, similarity: float, block: int) -> DataFrame:
    """rest with `cell` (its band of length and block in it) and `pair`: the pairs of cells (low, high) it is compared in.

    A bucket of up to `block` texts is one cell.  In a larger one similar lengths differ by a band at most, so a cell
    meets those of its own band and of the two beside it.
    """
    width = max(-math.log(similarity), 1e-3) * 1.001  # a little more than needed, against rounding at the edges
    whole = rest.groupBy("bucket").agg(((F.count(F.lit(1)) <= block) & (F.sum("n_words") <= BLOCK_WORDS)).alias("small")).filter("not small").select(F.col("bucket").alias("b1"))
    band = F.when(F.col("b1").isNull(), 0).otherwise(F.floor(F.log(F.greatest("n_words", F.lit(1))) / width).cast("int"))
    banded = rest.join(whole, F.col("bucket") == F.col("b1"), "left").select(*rest.columns, band.alias("band"))
    sizes = banded.groupBy("bucket", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    bands = sizes.groupBy(F.col("bucket").alias("b2")).agg(F.map_from_entries(F.collect_list(F.struct("band", F.greatest("blocks", F.lit(1)).alias("blocks")))).alias("bands"))
    dealt = banded.join(bands, F.col("bucket") == F.col("b2"))
    own = F.pmod(F.xxhash64("cls", F.lit(5)), F.try_element_at("bands", F.col("band"))).cast("int")
    dealt = dealt.withColumn("cell", F.struct("band", own.alias("part")))

    def with_band(step: int):
        band = F.col("band") + step
        there = F.sequence(F.lit(0), F.try_element_at("bands", band) - 1)
        other = F.transform(there, lambda j: F.struct(band.alias("band"), j.alias("part")))
        pairs = F.transform(other, lambda o: F.struct(F.least("cell", o).alias("low"), F.greatest("cell", o).alias("high")))
        return F.coalesce(pairs, F.array().cast("array<struct<low:struct<band:int,part:int>,high:struct<band:int,part:int>>>"))

    return dealt.select(*rest.columns, "cell", F.explode(F.concat(*(with_band(step) for step in (-1, 0, 1)))).alias("pair"))


def _rest_links(rest: DataFrame, classes: DataFrame, bodies: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) among bucket members that the bucket's first one didn't take, cell by cell.

    Every pair of different components is compared in the first sketch it shares: bounded out by its lengths, by its
    shared words, or aligned.  Texts within the edit distance share at least `similarity` of the longer one's words,
    with repeats; counts of hashed words bound that from above, so nothing is lost and texts that share a passage
    only are seldom aligned.  What is linked here is one component from then on.
    """
    dealt = _dealt(rest, similarity, block)
    keyed = dealt.join(classes.select(F.col("cls").alias("kc"), "keys").hint("merge"), F.col("cls") == F.col("kc"))
    wanted = bodies.join(rest.select(F.col("cls").alias("w")).distinct().hint("merge"), F.col("cls") == F.col("w"), "left_semi")
    keyed = keyed.join(_profiles(wanted).hint("merge"), F.col("cls") == F.col("pc"))
    cell = ["bucket", "low_band", "low_part", "high_band", "high_part"]
    keyed = keyed.select("bucket", *(F.col(f"pair.{side}.{part}").alias(f"{side}_{part}") for side in ("low", "high") for part in ("band", "part")), "cls", "n_words", "root", F.slice("keys", 1, F.col("sketch").cast("int")).alias("earlier"), "profile", "body", F.col("cell.band").alias("band"), F.col("cell.part").alias("part"))
    keyed = keyed.repartition(*cell).sortWithinPartitions(*cell)

    def run(batches):
        """Cells stand together in a partition; one that goes on in the next batch waits for it."""
        carry, out = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            begins = _begins([table[c].to_numpy() for c in cell])
            for start, stop in zip(begins, begins[1:]):
                out += compared(table, start, stop)
            carry = table.slice(begins[-1])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out = []
        if carry is not None:
            carry = carry.combine_chunks()
            out = compared(carry, 0, carry.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def compared(table: pa.Table, start: int, stop: int) -> list[tuple[int, int]]:
        root = table["root"].to_numpy()[start:stop].copy()
        if len(root) < 2 or (root == root[0]).all():
            return []
        group, out = table.slice(start, stop - start), []
        cls, n, band, part = (group[c].to_numpy() for c in ("cls", "n_words", "band", "part"))
        low, high = ((group[f"{side}_band"][0].as_py(), group[f"{side}_part"][0].as_py()) for side in ("low", "high"))
        left = np.flatnonzero((band == low[0]) & (part == low[1]))
        right = left if low == high else np.flatnonzero((band == high[0]) & (part == high[1]))
        earlier = group["earlier"].combine_chunks().flatten().to_numpy().reshape(len(group), -1) if len(group) else None
        marks = group["profile"].to_pylist()
        plain = np.array([bool(m) for m in marks])
        profiles = np.frombuffer(b"".join(m or bytes(2 * PROFILE) for m in marks), "<u2").reshape(len(group), PROFILE)
        bodies, read = group["body"], {}

        def sequence(k: int) -> np.ndarray:
            if k not in read:
                read[k] = word_hashes(words_of(bodies[k].as_py().encode()))
            return read[k]

        for i in left.tolist():
            others = right[right > i] if low == high else right
            most = np.maximum(n[others], n[i]) * similarity - 1e-6
            others = others[(np.minimum(n[others], n[i]) >= most) & (root[others] != root[i])]
            if not len(others):
                continue
            others = others[~((earlier[others] == earlier[i]) & (earlier[i] != 0)).any(1)]  # they meet in an earlier sketch
            shared = np.minimum(profiles[others], profiles[i]).sum(1, dtype=np.int64)
            others = others[~plain[others] | ~plain[i] | (shared >= similarity * np.maximum(n[others], n[i]) - 1e-6)]
            for j in others.tolist():
                if root[j] != root[i] and similar(sequence(i), sequence(j), similarity):
                    out.append((max(int(cls[i]), int(cls[j])), min(int(cls[i]), int(cls[j]))))
                    root[root == root[j]] = root[i]
        return out

    return keyed.mapInArrow(run, "a long, b long")


def _begins(columns: list[np.ndarray]) -> list[int]:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new).tolist()


def drop_near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """One document of each group, that with the least id, with all its columns; null texts all stay."""
    decided = _decided(docs, doc_id, text, **options)
    mark, times, hi, lo, hi2, lo2 = fresh(docs, "kept_id", "kept_times", "kept_hi", "kept_lo", "kept_h2", "kept_l2")
    ids = decided.filter("id is not null").groupBy(F.col("id").alias(mark)).agg(F.count(F.lit(1)).alias(times), F.bool_or("kept").alias("any_kept"))
    ids = cut(ids.filter("any_kept").select(mark, times), "omh-ids")
    # kept ids grow with the documents: always a shuffle join, the same plan at every size
    out = docs.join(ids.filter(F.col(times) == 1).hint("merge"), F.col(doc_id) == F.col(mark), "left_semi")
    repeated = ids.filter(F.col(times) > 1)
    if repeated.isEmpty() and decided.filter("id is null").isEmpty():
        return out
    # rows without an id, or that share theirs, are told apart by their text; those alike in both are one
    unclear = docs.join(repeated, F.col(doc_id) == F.col(mark), "left_semi").unionByName(docs.filter(F.col(doc_id).isNull()))
    schema = T.StructType([*docs.schema.fields, T.StructField(hi, T.LongType()), T.StructField(lo, T.LongType())])

    def tagged(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_class_keys(as_bytes(batch.column(text)))], names=schema.names)

    stay = decided.filter("kept and hi is not null").select(F.col("id").alias(mark), F.col("hi").alias(hi2), F.col("lo").alias(lo2)).distinct()
    alike = F.col(doc_id).eqNullSafe(F.col(mark)) & (F.col(hi) == F.col(hi2)) & (F.col(lo) == F.col(lo2))
    some = unclear.filter(F.col(text).isNotNull()).mapInArrow(tagged, schema).join(stay, alike, "left_semi")
    return out.unionByName(some.dropDuplicates([doc_id, hi, lo]).select(*docs.columns)).unionByName(unclear.filter(F.col(text).isNull()))
