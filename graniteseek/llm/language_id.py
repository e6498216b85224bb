"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes: after a context, a byte seen there costs its
share of the counts, and any other byte first pays the escape (as many escape counts as distinct bytes
seen, i.e. method C) and is then coded by the next shorter context, with the bytes already ruled out
excluded.  Order -1 is uniform over 256 bytes.  Counts are frozen after fitting, so the code length of a
text is exact and does not depend on batches.  The shortest code wins.

The trees of all languages are united into one automaton: its state after a byte is the longest kept context
that ends there, and each (state, byte) has the code length under every language.  Texts are cut into
segments which start with the last `order` bytes of the one before; as a state depends on those only, all
segments of a batch advance in lockstep in numpy and their sums are those of the whole text.

Training (`fit_language_model`) counts every byte of every labelled text.  Whether a context is among the `states` best
is known from the counts of all texts only, so contexts grow by a byte a pass: the texts run through the automaton of
the contexts kept so far, and what a context of the pass's length meets next makes the contexts of the next one.  A
context occurs at least as often as any that holds it, so nothing kept at the end is missed.  The last pass counts what
follows each kept context in each language.  A pass is a map that sums in a table of the model's size, and one sum by
cell.  Contexts are ranked by their places, those of a language with more than `bytes_per_language` bytes scaled down to
as many, so that a frequent language doesn't take all.

The model's size is bounded (documented parameters): `states` contexts, tables of `table_bytes`, and the `languages` most
frequent languages.  Only counts for a model of that size reach the driver.  Prediction is a map over all rows without a
shuffle.  `fit_ppm` makes the same model of texts in memory, and `labelled_sample` draws such texts, bounded in rows and
bytes, for a quick look; no registered query uses a sample.

A filter rejects what no language explains.  Its limit in bits a byte (`calibrated_limit`) comes from all labelled
texts that the model hasn't seen: `reject_factor` times the `reject_quantile` point of their rates, each rounded up to
1/1024 bit, and no less than the 8 bits that plain bytes cost; it applies to the text's bytes plus `reject_bytes`, as
the first bytes of a short text have no context.

Cases: `und` with score 0 if the text is null or has no letter.  Ties go to the first language by name.  A text of any
length is coded and learnt whole, in segments.  Repeated rows are predicted each and train once.  Null languages, null
ids and empty texts don't train.  With no training
rows every text is `und`, and the filter, which then has nothing to tell languages by, keeps all that has a letter.
An empty table gives an empty one.  Extra columns are ignored by `predict_language` and kept by `keep_identified`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, cut, free, fresh, sliced

UNDETERMINED = "und"
SEGMENT = 256
BLOCK = 2 << 20  # bytes of text that advance together
GRID = 1024  # steps of a bit that rates are rounded up to
BATCH_CELLS = 1 << 16  # rows of counts sent on at once
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class PpmOptions:
    order: int = 5
    languages: int = 64
    rows_per_language: int = 300
    row_bytes: int = 32 << 10
    bytes_per_language: int = 400 << 10
    states: int = 12_000
    table_bytes: int = 48 << 20
    reject_quantile: float = 0.99
    reject_factor: float = 2.0
    reject_bytes: int = 16
    plain_bits: float = 8.0


@dataclass
class PpmModel:
    languages: list[str]
    order: int
    stride: int  # classes of a state, padding included; padding is the last
    classes: np.ndarray = field(repr=False)  # of each byte
    step: np.ndarray = field(repr=False)  # next state of (state, class), flat
    cost: np.ndarray = field(repr=False)  # bits of (state, class) by language

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for part in _blocks(texts):
            out[part] = self._block(texts[part])
        return out

    def _block(self, texts: list[bytes]) -> np.ndarray:
        lead = self.order
        columns, segments = _lanes(texts, self.classes, lead, self.stride - 1)
        if not segments.sum():
            return np.zeros((len(texts), len(self.languages)))
        begins = np.concatenate(([0], np.cumsum(segments)[:-1]))
        state = np.zeros(columns.shape[1], np.int32)
        bits = np.zeros((columns.shape[1], len(self.languages)), np.float32)
        total = np.zeros((columns.shape[1], len(self.languages)))
        for k in range(columns.shape[0]):
            at = state * self.stride + columns[k]
            if k >= lead:
                bits += np.take(self.cost, at, axis=0)
                if k % 64 == 63:
                    total += bits
                    bits[:] = 0
            state = np.take(self.step, at)
        total += bits
        sums = np.zeros((len(texts), len(self.languages)))
        full = segments > 0
        sums[full] = np.add.reduceat(total, begins[full], axis=0)
        return sums


def _blocks(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about BLOCK bytes."""
    k = 0
    while k < len(texts):
        size, stop = 0, k
        while stop < len(texts) and (stop == k or size + len(texts[stop]) <= BLOCK):
            size += len(texts[stop])
            stop += 1
        yield slice(k, stop)
        k = stop


def _lanes(texts: list[bytes], classes: np.ndarray, lead: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the bytes, one column a segment that starts with the last `lead` ones before it; segments of each text."""
    segments = np.array([-(-len(t) // SEGMENT) for t in texts])
    begins = np.concatenate(([0], np.cumsum(segments)[:-1]))
    rows = np.full((int(segments.sum()), lead + SEGMENT), pad, classes.dtype)
    for text, n, at in zip(texts, segments, begins):
        if n:
            line = np.full(n * SEGMENT, pad, classes.dtype)
            line[: len(text)] = classes[np.frombuffer(text, np.uint8)]
            grid = line.reshape(n, SEGMENT)
            rows[at : at + n, lead:] = grid
            rows[at + 1 : at + n, :lead] = grid[:-1, SEGMENT - lead :]
    return np.ascontiguousarray(rows.T), segments


@dataclass
class Automaton:
    """Contexts by order; the state after a byte is the longest one that ends there."""

    contexts: list[np.ndarray] = field(repr=False)  # sorted, the newest class lowest, 8 bits each
    classes: np.ndarray = field(repr=False)  # of each byte
    width: int  # classes; padding comes after them and leads back to the root
    first: np.ndarray = field(init=False)  # state of each order's first context
    step: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.first = np.concatenate(([0], np.cumsum([len(c) for c in self.contexts])))
        self.step = np.zeros((self.states, self.stride), np.int32)
        for order, keys in enumerate(self.contexts):
            if order:
                self.step[self.rows(order)] = self.step[self.shorter(order)]
            if order + 1 < len(self.contexts):
                longer = self.contexts[order + 1]
                self.step[self.first[order] + np.searchsorted(keys, longer >> 8), longer & 255] = self.first[order + 1] + np.arange(len(longer))

    @property
    def stride(self) -> int:
        return self.width + 1

    @property
    def states(self) -> int:
        return int(self.first[-1])

    def rows(self, order: int) -> slice:
        return slice(self.first[order], self.first[order + 1])

    def shorter(self, order: int) -> np.ndarray:
        """For each context of an order, the state of its end that is a byte shorter."""
        return self.first[order - 1] + np.searchsorted(self.contexts[order - 1], self.contexts[order] & ((1 << (8 * (order - 1))) - 1))

    def places(self, texts: list[bytes], languages: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells (language, state, class) of the texts' bytes, each with how often it occurs in a part of them."""
        lead, pad = len(self.contexts) - 1, self.width
        columns, segments = _lanes(texts, self.classes, lead, pad)
        size = self.states * self.stride
        kind = np.int32 if (int(languages.max(initial=0)) + 1) * size < 2**31 else np.int64
        base = np.repeat(languages.astype(kind) * size, segments)
        state, step = np.zeros(columns.shape[1], np.int32), self.step.reshape(-1)
        part, held = [], 0
        for k in range(lead + SEGMENT):
            at = state * self.stride + columns[k]
            if k >= lead:
                part.append((base + at)[columns[k] != pad])
                held += len(part[-1])
                if held >= BLOCK or k + 1 == lead + SEGMENT:
                    yield np.unique(np.concatenate(part), return_counts=True)
                    part, held = [], 0
            state = np.take(step, at)


@dataclass
class Counts:
    """Sums of places for an automaton: by cell, or by (state, class) of some states with languages weighed."""

    auto: Automaton
    languages: int
    weights: list[int] | None = None
    since: int = 0

    def summed(self, parts: Iterator[tuple[list[bytes], np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns of the counts of all parts: cell, n and, with weights, weight."""
        size = self.auto.states * self.auto.stride
        table, held = np.zeros(self.languages * size, np.int32), 0
        for texts, languages in parts:
            for part in _blocks(texts):
                for cells, n in self.auto.places(texts[part], languages[part]):
                    if held + n.sum() >= 2**31:
                        yield self._columns(table)
                        table[:], held = 0, 0
                    table[cells] += n.astype(np.int32)
                    held += int(n.sum())
        if held:
            yield self._columns(table)

    def _columns(self, table: np.ndarray) -> tuple[np.ndarray, ...]:
        if self.weights is None:
            cells = np.flatnonzero(table)
            return cells, table[cells].astype(np.int64)
        rows = table.reshape(self.languages, -1)
        n = rows.sum(0, dtype=np.int64)
        n[: self.since * self.auto.stride] = 0
        cells = np.flatnonzero(n)
        return cells, n[cells], sum(w * row[cells].astype(np.int64) for w, row in zip(self.weights, rows))


#: Sums over all texts; with a number, only the rows of the greatest weights that occur twice or more, one more than it.
Count = Callable[[Counts, "int | None"], tuple[np.ndarray, ...]]


def _fit(sizes: dict[str, int], options: PpmOptions, count: Count) -> PpmModel:
    """The model of texts that `count` counts; `sizes` has the bytes of each language."""
    languages = sorted(sizes)
    if not languages:
        return PpmModel([], options.order, 1, np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    unit = (1 << 62) // (len(languages) * options.bytes_per_language)
    weights = [max(1, unit * min(options.bytes_per_language, sizes[g]) // max(1, sizes[g])) for g in languages]

    # pairs of bytes: each byte is a context of its own
    root = np.zeros(1, np.int64)
    auto = Automaton([root, np.arange(256)], np.arange(256, dtype=np.uint16), 256)
    cells, n, weight = count(Counts(auto, len(languages), weights), None)
    state, byte = np.divmod(cells, auto.stride)
    ones, ones_weight = np.zeros(256, np.int64), np.zeros(256, np.int64)
    np.add.at(ones, byte, n)
    np.add.at(ones_weight, byte, weight)
    known = np.flatnonzero(ones)
    classes = np.full(256, len(known), np.uint8 if len(known) < 254 else np.uint16)  # the last class is any byte not seen
    classes[known] = np.arange(len(known))
    width = len(known) + 1
    most = min(options.states, options.table_bytes // ((width + 1) * 4 * (len(languages) + 1)))
    pair = (state > 0) & (n > 1)
    keys = (classes[(state[pair] - 1) % 256].astype(np.int64) << 8) | classes[byte[pair]]
    twice = known[ones[known] > 1]
    found = [(classes[twice].astype(np.int64), ones_weight[twice]), (keys, weight[pair])][: options.order]

    # a context is kept by its places, so its own prefixes and suffixes are kept too
    def kept() -> list[np.ndarray]:
        every = np.sort(np.concatenate([w for _, w in found]))[::-1] if found else root
        least = int(every[most]) if len(every) > most else 0
        return [root] + [np.sort(k[w > least]) for k, w in found]

    for order in range(2, options.order):
        auto = Automaton(kept(), classes, width)
        cells, n, weight = count(Counts(auto, len(languages), weights, int(auto.first[order])), most)
        state, byte = np.divmod(cells, auto.stride)
        found.append(((auto.contexts[order][state - auto.first[order]] << 8) | byte, weight))
    auto = Automaton(kept(), classes, width)
    cells, n = count(Counts(auto, len(languages)), None)
    table = np.zeros(len(languages) * auto.states * auto.stride, np.int64)
    table[cells] = n
    return _coded(languages, options, auto, table.reshape(len(languages), auto.states, auto.stride))


def _coded(languages: list[str], options: PpmOptions, auto: Automaton, table: np.ndarray) -> PpmModel:
    """Code lengths from places by (language, state, class), which become those by context here."""
    width, unseen = auto.width, 256 - (auto.width - 1)
    for order in range(len(auto.contexts) - 1, 0, -1):
        at = auto.shorter(order)
        for places in table:
            np.add.at(places, at, places[auto.rows(order)])
    chance = np.zeros((auto.states, width, len(languages)))
    for order, keys in enumerate(auto.contexts):
        rows = auto.rows(order)
        base = chance[auto.shorter(order)] if order else np.full((1, width, len(languages)), 1 / 256)
        n = table[:, rows, :width].transpose(1, 2, 0)
        # the class of bytes not seen stands for `unseen` bytes; its chance is that of one of them
        share = np.ones(width)
        share[-1] = unseen
        distinct, total = (n > 0).sum(1), n.sum(1)
        rest = np.where(n > 0, 0, base * share[None, :, None]).sum(1)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
        escape = np.where(rest > 0, escape, 0.0)  # nothing is left to escape to
        coded = np.where(escape > 0, total + distinct, np.maximum(total, 1))
        coded = np.maximum(coded, 1)
        chance[rows] = np.where(n > 0, n / coded[:, None, :], base * (escape / np.where(rest > 0, rest, 1))[:, None, :])
    cost = np.zeros((auto.states, width + 1, len(languages)), np.float32)
    cost[:, :width] = -np.log2(np.maximum(chance, 1e-30))
    return PpmModel(languages, options.order, width + 1, auto.classes, auto.step.reshape(-1), cost.reshape(auto.states * (width + 1), len(languages)))


def fit_ppm(samples: dict[str, list[bytes]], options: PpmOptions = PpmOptions()) -> PpmModel:
    """The model of texts in memory, by language."""
    texts = [t for g in sorted(samples) for t in samples[g]]
    languages = np.repeat(np.arange(len(samples)), [len(samples[g]) for g in sorted(samples)])

    def count(counts: Counts, most: int | None) -> tuple[np.ndarray, ...]:
        parts = list(counts.summed(iter([(texts, languages)])))
        rows = np.concatenate([np.stack(p) for p in parts], 1) if parts else np.zeros((3, 0), np.int64)
        cells, back = np.unique(rows[0], return_inverse=True)
        sums = np.zeros((len(rows) - 1, len(cells)), np.int64)
        for total, column in zip(sums, rows[1:]):
            np.add.at(total, back, column)
        if most is not None:
            best = np.lexsort((cells, -sums[1]))
            best = best[sums[0][best] > 1][: most + 1]
            return cells[best], *sums[:, best]
        return cells, *sums[: 1 if counts.weights is None else 2]

    return _fit({g: sum(map(len, t)) for g, t in samples.items()}, options, count)


def _packed(frame: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns of longs, brought to the driver as a few packed rows."""
    names = frame.columns

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([column.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for column in batch.columns], names=names)

    rows = frame.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).collect()
    return tuple(np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) if rows else np.zeros(0, np.int64) for k in range(len(names)))


def _labelled(docs: DataFrame, usable: Column, doc_id: str, text: str, lang: str) -> tuple[DataFrame, DataFrame | None]:
    """Labelled texts that aren't empty, as lang and body; equal rows once, for which they are written if there are any."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.octet_length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("body"))
    if rows.groupBy(F.xxhash64("lang", "id", "body")).count().filter(F.col("count") > 1).isEmpty():
        return rows.select("lang", "body"), None
    once = cut(rows.dropDuplicates().select("lang", "body"), "labelled")
    return once, once


def fit_language_model(docs: DataFrame, usable: Column, doc_id="doc_id", text="text", lang="lang", options: PpmOptions = PpmOptions()) -> PpmModel:
    """The model of all usable labelled texts, counted where they lie."""
    rows, written = _labelled(docs, usable, doc_id, text, lang)
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("size")).orderBy(F.desc("n"), "lang").limit(options.languages).collect()
    sizes = {r["lang"]: r["size"] for r in found}
    number = {g: k for k, g in enumerate(sorted(sizes))}

    def count(counts: Counts, most: int | None) -> tuple[np.ndarray, ...]:
        shipped = docs.sparkSession.sparkContext.broadcast(counts)
        names = ["cell", "n"] if counts.weights is None else ["cell", "n", "weight"]

        def parts(batches):
            for batch in batches:
                for piece in sliced([batch]):
                    at = [number.get(g, -1) for g in piece.column("lang").to_pylist()]
                    bodies = as_bytes(piece.column("body"))
                    yield [b for b, k in zip(bodies, at) if k >= 0], np.array([k for k in at if k >= 0], np.int64)

        def run(batches):
            for columns in shipped.value.summed(parts(batches)):
                for k in range(0, len(columns[0]), BATCH_CELLS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BATCH_CELLS], pa.int64()) for c in columns], names=names)

        sums = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("cell").agg(*(F.sum(c).alias(c) for c in names[1:]))
        if most is not None:
            sums = sums.filter(F.col("n") > 1).orderBy(F.desc("weight"), "cell").limit(most + 1)
        out = _packed(sums)
        shipped.unpersist()
        return out

    model = _fit(sizes, options, count)
    free(written)
    return model


def labelled_sample(docs: DataFrame, usable: Column, doc_id: str, text: str, lang: str, options: PpmOptions) -> dict[str, list[bytes]]:
    """A sample for a quick look, not what the queries learn from: whole texts by language, those whose id and text hash
    lowest, up to the bounds; equal rows count once."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    sizes = rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(options.languages).collect()
    if not sizes:
        return {}
    place = (F.xxhash64(F.col(doc_id).cast("string"), F.lit(8), F.col(text)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    chosen = F.lit(False)
    for name, n in sizes:
        chosen |= (F.col(lang) == F.lit(name)) & (place < F.lit(min(1.0, options.rows_per_language / n)))
    order = ["place", "id", "body"]
    found = rows.filter(chosen & (F.octet_length(text) <= options.row_bytes)).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("body"), place.alias("place"), F.col(doc_id).cast("string").alias("id"))
    found = found.dropDuplicates(["lang", *order])  # so that one repeated row can't bring more than its share
    # whole texts while those before them are under the bound; a language's candidates are `rows_per_language` in the mean
    before = F.coalesce(F.sum(F.octet_length("body")).over(Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("before", before).filter(F.col("before") < options.bytes_per_language)
    out: dict[str, list[bytes]] = {}
    for row in sorted(found.select("lang", *order).collect(), key=lambda r: (r["place"], r["id"], bytes(r["body"]))):
        out.setdefault(row["lang"], []).append(bytes(row["body"]))
    return out


def reject_limit(model: PpmModel, samples: dict[str, list[bytes]], options: PpmOptions = PpmOptions()) -> float:
    """Bits a byte beyond which no language explains a text, from labelled texts that the model hasn't learnt."""
    rates = []
    for language in set(samples) & set(model.languages):
        texts = [t for t in samples[language] if _LETTER.search(t.decode("utf-8", "replace"))]
        if texts:
            bits = model.code_lengths(texts)[:, model.languages.index(language)]
            rates += [b / (len(t) + options.reject_bytes) for b, t in zip(bits, texts)]
    return max(options.plain_bits, options.reject_factor * float(np.quantile(rates, options.reject_quantile))) if rates else float("inf")


def calibrated_limit(docs: DataFrame, usable: Column, model: PpmModel, doc_id="doc_id", text="text", lang="lang", options: PpmOptions = PpmOptions()) -> float:
    """`reject_limit` of all usable labelled texts, their rates rounded up to 1/1024 bit and counted where they lie."""
    if not model.languages:
        return float("inf")
    rows, written = _labelled(docs, usable, doc_id, text, lang)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        number = {g: k for k, g in enumerate(shipped.value.languages)}
        for batch in sliced(batches):
            known = [(b, number[g]) for b, g in zip(as_bytes(batch.column("body")), batch.column("lang").to_pylist()) if g in number and _LETTER.search(b.decode("utf-8", "replace"))]
            bits = shipped.value.code_lengths([b for b, _ in known])[np.arange(len(known)), [k for _, k in known]] if known else np.zeros(0)
            steps, n = np.unique(np.ceil(GRID * bits / np.array([len(b) + options.reject_bytes for b, _ in known])).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(n, pa.int64())], names=["step", "n"])

    steps, n = _packed(rows.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")))
    shipped.unpersist()
    free(written)
    if not len(steps):
        return float("inf")
    order = np.argsort(steps)
    ends = np.cumsum(n[order])
    place = options.reject_quantile * (int(ends[-1]) - 1)
    low, high = (steps[order][np.searchsorted(ends, k, side="right")] / GRID for k in (int(np.floor(place)), int(np.ceil(place))))
    return max(options.plain_bits, options.reject_factor * float(low + (high - low) * (place - np.floor(place))))


def _predict(model: PpmModel, bodies: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, posterior under equal priors, and bits a byte of the best language."""
    names, scores, rates = [UNDETERMINED] * len(bodies), [0.0] * len(bodies), [0.0] * len(bodies)
    real = [k for k, b in enumerate(bodies) if b and _LETTER.search(b.decode("utf-8", "replace"))] if model.languages else []
    bits = model.code_lengths([bodies[k] for k in real])
    for k, row in zip(real, bits):
        best = int(row.argmin())
        names[k], rates[k] = model.languages[best], float(row[best]) / len(bodies[k])
        scores[k] = float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum())
    return names, scores, rates


def predict_language(docs: DataFrame, model: PpmModel, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document row: doc_id, lang_pred, score (0 to 1), bits_per_byte."""
    schema = T.StructType([docs.schema[doc_id]] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            names, scores, rates = _predict(shipped.value, as_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: PpmModel, limit: float, text="text", options: PpmOptions = PpmOptions()) -> DataFrame:
    """The documents whose language is determined, with all their columns.

    Rejected: texts without a letter, and texts whose best code needs more than `limit` bits a byte.
    """
    keep, = fresh(docs, "identified")
    schema = T.StructType([*docs.schema.fields, T.StructField(keep, T.BooleanType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            bodies = as_bytes(batch.column(text))
            if shipped.value.languages:
                names, _, rates = _predict(shipped.value, bodies)
                ok = [n != UNDETERMINED and r * len(b) <= limit * (len(b) + options.reject_bytes) for n, r, b in zip(names, rates, bodies)]
            else:
                ok = [bool(b and _LETTER.search(b.decode("utf-8", "replace"))) for b in bodies]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema).filter(F.col(keep)).drop(keep)
