"""Toxicity by a weighted finite-state pattern grammar that scores matched clauses, not isolated words.

A text is a string of token classes: clause ends, line ends, quotation marks, targets (`you`), negations, reporting
verbs, modals, threat verbs, insults and other words.  Five small transducers read it in turn and annotate what the next
one sees: the target, negation and reported-speech transducers open a scope that ends after some words or with the
clause (quotations: with the next mark or the line), the threat transducer wants a modal before its verb, and the insult
transducer writes an event for each match.  They are composed once into a single deterministic transducer with a few
hundred states.  An insult or threat is `aimed` if a target stands in scope before it or follows soon, else `bare`;
under a negation or in reported speech it becomes an event of that kind, whose weight is learnt apart.

Insults are arcs of a weighted prefix tree: words and stems (first letters) with their log-odds of standing in toxic
rather than clean texts, less `z` standard errors, so that inflected words are found by their stem.  A clause's score
by kind is the sum of its matches' weights; a text's features are these sums, absolute and for its length, and the share
of clauses matched.  A logistic regression with a prior on its weights (so that few or no labels still give a model)
turns features into a score; matches count, not the words around them.

Fitting uses a bounded sample of `sample_rows` labelled documents, those whose id hashes lowest; equal texts count once.
Stems are counted on three quarters of them by a distributed count, the regression is fitted on the other quarter, so
that stems which stand in toxic texts by chance don't count twice.  The sample's ids are broadcast (16 bytes each), the
texts are read once; scoring is a map over all rows without a shuffle.

Cases: null and empty texts get the score of a text without a match.  Texts of any length are read whole.  Repeated
rows are scored each.  Labels: a null id or label isn't used, several labels of an id count by their mean.  Without
labels the prior and the base words remain.  An empty table gives an empty one.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free, sliced

OTHER, END, LINE, QUOTE, TARGET, NEGATION, REPORT, MODAL, THREAT, INSULT = range(10)
KINDS = ("bare", "aimed", "negated", "reported", "threat")

#: Base words by class, in the languages of the corpus; all lower case.
WORDS = {
    TARGET: "you your yours you're ur u they them he him she her du dich dir euch ihr sie tu toi te vous ti usted ustedes vosotros".split(),
    NEGATION: "not no never nobody isn't aren't wasn't don't without nicht kein keine keinen nie ohne ne pas jamais sans nunca ni sin".split(),
    REPORT: "said says say wrote writes called calls quoted quotes reported claimed alleged sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split(),
    MODAL: "will gonna going shall should must want i'll we'll werde werden soll sollte vais va allons doit voy vamos debe quiero".split(),
    THREAT: "kill hurt destroy beat stab shoot strangle murder punish smash töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split(),
}
BASE_INSULTS = "idiot moron stupid trash scum loser clown pathetic worthless disgusting dumb imbecile filth vermin scumbag dummkopf abschaum versager idiote imbécile connard ordure estúpido imbécil basura escoria".split()
BASE_WEIGHT = 4.0

_FOLD = bytearray(b" " * 256)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128 or _b in b"'\"":
        _FOLD[_b] = _b
    elif _b in b".!?;:\n":
        _FOLD[_b] = 10 if _b == 10 else 46
_FOLD = bytes(_FOLD)


@dataclass(frozen=True)
class ToxicityOptions:
    sample_rows: int = 20_000
    stems: int = 50_000
    shortest: int = 3
    longest: int = 8
    saturation: int = 8
    documents: int = 3
    z: float = 1.64
    least: float = 2.0
    target_reach: int = 6
    negation_reach: int = 4
    modal_reach: int = 4
    late_reach: int = 3
    remembered: int = 400_000


# --- transducers ---------------------------------------------------------------------------------------------------
# A transducer is a start state and a function (state, symbol) -> (state, symbol); a symbol is a class and its marks.


def scope(mark: str, opens: tuple[int, ...], closes: tuple[int, ...], reach: int | None):
    """Marks what stands up to `reach` tokens (None: any number) after an opening class and before a closing one."""
    def step(left, symbol):
        kind, marks = symbol
        out = (kind, marks | {mark}) if left else symbol
        if kind in closes:
            return 0, out
        if kind in opens:
            return reach or 1, out
        return (left if reach is None else max(0, left - 1)), out

    return 0, step


def quotation(mark: str):
    """Marks what stands between two quotation marks of a line."""
    def step(inside, symbol):
        kind, marks = symbol
        out = (kind, marks | {mark}) if inside else symbol
        return (0 if kind == LINE else 1 - inside if kind == QUOTE else inside), out

    return 0, step


def threats():
    """A threat verb counts if a modal stands before it; otherwise it is a word like others."""
    def step(state, symbol):
        kind, marks = symbol
        return 0, ((OTHER, marks) if kind == THREAT and "modal" not in marks else symbol)

    return 0, step


def matches(late: int):
    """Writes the event of an insult or threat: its kind, or None; a target soon after makes a bare insult an aimed one.

    The last is an event of its own, `late`, as what was written can't be changed.
    """
    def step(waits, symbol):
        kind, marks = symbol
        if kind in (INSULT, THREAT):
            if marks & {"reported", "quoted"}:
                return 0, "reported"
            if "negated" in marks:
                return 0, "negated"
            if kind == THREAT:
                return 0, "threat"
            return (0, "aimed") if "aimed" in marks else (late, "bare")
        if kind == TARGET and waits:
            return 0, "late"
        return (0 if kind in (END, LINE) else max(0, waits - 1)), None

    return 0, step


def compose(*parts) -> tuple[np.ndarray, list[list[str | None]]]:
    """One deterministic transducer: next state and event by (state, class), from the states that can be reached."""
    start = tuple(s for s, _ in parts)
    numbers, todo, rows, events = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        row, said = [], []
        for kind in range(10):
            symbol, after = (kind, frozenset()), []
            for part, (_, step) in zip(state, parts):
                part, symbol = step(part, symbol)
                after.append(part)
            after = tuple(after)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
            said.append(symbol)
        rows.append(row)
        events.append(said)
    return np.array(rows, np.int32), events


def grammar(options: ToxicityOptions = ToxicityOptions()):
    ends = (END, LINE)
    return compose(
        scope("aimed", (TARGET,), ends, options.target_reach),
        scope("negated", (NEGATION,), ends, options.negation_reach),
        scope("reported", (REPORT,), ends, None),
        quotation("quoted"),
        scope("modal", (MODAL,), ends, options.modal_reach),
        threats(),
        matches(options.late_reach),
    )


# --- model ---------------------------------------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    insults: dict[str, float]  # whole words
    stems: dict[str, float]  # first letters
    weights: np.ndarray
    options: ToxicityOptions = ToxicityOptions()
    _known: dict = field(default_factory=dict, repr=False)
    _table: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_table": []}

    def _prepare(self) -> None:
        step, events = grammar(self.options)
        kinds = {None: -1, "late": len(KINDS), **{k: i for i, k in enumerate(KINDS)}}
        self._table = [[(int(n), kinds[e]) for n, e in zip(row, said)] for row, said in zip(step, events)]
        # where words of no class lead, for gaps up to the longest scope
        reach = max(self.options.target_reach, self.options.negation_reach, self.options.modal_reach, self.options.late_reach)
        self._gap = [list(range(len(step)))]
        for _ in range(reach):
            self._gap.append([int(step[s, OTHER]) for s in self._gap[-1]])
        self._known = {**{w.encode(): (c, 0.0) for c, words in WORDS.items() for w in words}, b'"': (QUOTE, 0.0), b".": (END, 0.0), b"\n": (LINE, 0.0)}
        self._fixed = dict(self._known)

    def _class_of(self, word: bytes):
        """The class and weight of a word that isn't known yet, or None."""
        if len(self._known) > self.options.remembered:
            self._known = dict(self._fixed)
        text = word.decode("utf-8", "replace").strip("'")
        weight = self.insults.get(text, 0.0)
        for k in range(self.options.shortest, min(len(text), self.options.longest) + 1):
            weight = max(weight, self.stems.get(text[:k], 0.0))
        found = (INSULT, weight) if weight > 0 else self._fixed.get(text.encode())
        self._known[word] = found
        return found

    def features(self, text: str | None) -> tuple[list[float], int, list[float]]:
        """Features of a text, its matched clauses, and the sums of weights by kind."""
        if not self._table:
            self._prepare()
        body = (text or "").lower()
        for mark in "“”«»„":
            if mark in body:
                body = body.replace(mark, '"')
        body = body.replace("’", "'").encode("utf-8", "replace").translate(_FOLD)
        tokens = body.replace(b'"', b' " ').replace(b".", b" . ").replace(b"\n", b" \n ").split(b" ")
        tokens = [t for t in tokens if t]
        known = self._known
        sums, words, clauses, matched, clause = [0.0] * len(KINDS), 0, 1, 0, False
        state, last, weight = 0, -1, 0.0
        for k, token in enumerate(tokens):
            found = known[token] if token in known else self._class_of(token)
            if found is None:
                continue
            kind, own = found
            state = self._gap[min(k - last - 1, len(self._gap) - 1)][state]
            last = k
            state, event = self._table[state][kind]
            if kind in (END, LINE):
                clauses += 1
                clause = False
                words -= 1
            elif event == len(KINDS):  # the bare insult before was meant for this target
                sums[0] -= weight
                sums[1] += weight
            elif event >= 0:
                weight = own or BASE_WEIGHT
                sums[event] += weight
                if not clause:
                    matched += 1
                    clause = True
        words += len(tokens)
        share = [10 * s / (words + 25) for s in sums]
        return [1.0, *(math.log1p(max(0.0, s)) for s in sums), *share, matched / clauses, math.log1p(words) / 5], matched, sums

    def score(self, text: str | None) -> tuple[float, int, list[float]]:
        features, matched, sums = self.features(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, float(np.dot(self.weights, features)))))), matched, sums


#: Prior weights: bias; sums by kind; sums for the length by kind; share of matched clauses; length.
PRIOR = np.array([-4.0] + [0.6, 0.9, 0.0, 0.1, 0.9] + [3.0, 4.0, 0.0, 0.5, 4.0] + [1.0, 0.0])
PRIOR_PRECISION = np.array([0.1] + [0.5] * 5 + [0.2] * 5 + [0.2, 0.5])


def fit_weights(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a normal prior around PRIOR."""
    w = PRIOR.copy()
    if not len(labels):
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -40, 40)))
        gradient = features.T @ (p - labels) + PRIOR_PRECISION * (w - PRIOR)
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag(PRIOR_PRECISION)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame, usable: Column, options: ToxicityOptions, doc_id="doc_id", text="text", toxic="toxic") -> DataFrame:
    """body, toxic (0 or 1), part (0 to 3) of the distinct texts of a bounded sample of labelled documents."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("double").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(11)), "id").limit(options.sample_rows)
    rows = docs.filter(usable & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    rows = rows.join(F.broadcast(known), "id").select("body", "toxic", F.xxhash64("body").alias("hash"))
    return rows.groupBy("hash").agg(F.first("body").alias("body"), F.max("toxic").alias("toxic")).select("body", "toxic", F.pmod("hash", F.lit(4)).cast("int").alias("part"))


def words_for_stems(text: str) -> Counter:
    body = text.lower().replace("’", "'").encode("utf-8", "replace").translate(_FOLD)
    return Counter(w.decode("utf-8", "replace").strip("'") for w in body.replace(b'"', b" ").replace(b".", b" ").split())


def stem_counts(texts: DataFrame, options: ToxicityOptions) -> DataFrame:
    """gram (a word and `$`, or first letters), by label: texts with it and saturated places; `` is all words."""
    schema = "gram string, toxic int, documents long, places long"

    def count(batches):
        for batch in batches:
            documents, places = Counter(), Counter()
            for text, toxic in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist()):
                own = Counter()
                for word, n in words_for_stems(text).items():
                    n = min(n, options.saturation)
                    own[word + "$"] += n
                    own[""] += n
                    for k in range(options.shortest, min(len(word), options.longest) + 1):
                        own[word[:k]] += n
                for gram, n in own.items():
                    documents[gram, toxic] += 1
                    places[gram, toxic] += n if gram == "" else min(n, options.saturation)
            keys = list(places)
            yield pa.RecordBatch.from_pydict({"gram": pa.array([g for g, _ in keys], pa.string()), "toxic": pa.array([t for _, t in keys], pa.int32()), "documents": pa.array([documents[k] for k in keys], pa.int64()), "places": pa.array([places[k] for k in keys], pa.int64())})

    return texts.mapInArrow(count, schema).groupBy("gram", "toxic").agg(F.sum("documents").alias("documents"), F.sum("places").alias("places"))


def learnt_insults(texts: DataFrame, options: ToxicityOptions) -> dict[str, float]:
    """Words (with `$`) and stems by their log-odds less `z` standard errors; at most `stems` of them."""
    counts = stem_counts(texts, options)
    of = lambda label, column: F.sum(F.when(F.col("toxic") == label, F.col(column)).otherwise(0))
    grams = counts.groupBy("gram").agg(of(1, "places").alias("t"), of(0, "places").alias("c"), of(1, "documents").alias("d"))
    grams = cut(grams.filter(f"d >= {options.documents} or gram = ''"), "toxic-stems")
    whole = grams.filter("gram = ''").select("t", "c").first()
    out = {}
    if whole and whole.t and whole.c:
        t, c = F.col("t") + 0.5, F.col("c") + 0.5
        weight = F.log(t / F.lit(float(whole.t))) - F.log(c / F.lit(float(whole.c))) - options.z * F.sqrt(1 / t + 1 / c)
        found = grams.filter("gram <> ''").select("gram", weight.alias("weight")).filter(F.col("weight") >= options.least)
        out = {r.gram: float(r.weight) for r in found.orderBy(F.desc("weight"), "gram").limit(options.stems).collect()}
    free(grams)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, options: ToxicityOptions = ToxicityOptions(), **names) -> ToxicityModel:
    """The model of the labelled documents for which `usable` is true."""
    texts = cut(labelled_texts(docs, labels, usable, options, **names), "toxic-sample")
    grams = learnt_insults(texts.filter("part <> 0"), options)
    insults = {w: BASE_WEIGHT for w in BASE_INSULTS} | {g[:-1]: w for g, w in grams.items() if g.endswith("$")}
    model = ToxicityModel(insults, {g: w for g, w in grams.items() if not g.endswith("$")}, PRIOR, options)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in sliced(batches):
            rows = [shipped.value.features(x)[0] for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = texts.filter("part = 0").mapInArrow(features, "toxic int, x array<double>").collect()
    rows = sorted((r.toxic, *r.x) for r in rows)
    grid = np.array([r[1:] for r in rows]).reshape(len(rows), len(PRIOR))
    model.weights = fit_weights(grid, np.array([r[0] for r in rows], float))
    shipped.destroy()
    free(texts)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document row: doc_id, score (0 to 1), predicted, n_clauses (matched ones), and the sums by kind."""
    schema = T.StructType([
        docs.schema[doc_id], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("n_clauses", T.LongType()), *(T.StructField(k, T.DoubleType()) for k in KINDS)])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            found = [shipped.value.score(x) for x in batch.column(text).to_pylist()]
            scores = [s for s, _, _ in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(doc_id), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([n for _, n, _ in found], pa.int64()), *(pa.array([x[k] for _, _, x in found], pa.float64()) for k in range(len(KINDS)))], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.5, text="text") -> DataFrame:
    """The documents that score under `limit`, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array([shipped.value.score(x)[0] < limit for x in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
