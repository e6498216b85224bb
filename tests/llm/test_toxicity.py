import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteseek.llm.queries import unlabelled
from graniteseek.llm.toxicity import KINDS, PRIOR, ToxicityModel, ToxicityOptions, drop_toxic, fit_toxicity, fit_weights, grammar, score_toxicity

BASE = ToxicityModel({"idiot": 4.0, "clown": 4.0}, {"dumm": 3.0}, PRIOR)


@pytest.mark.parametrize(("text", "kinds"), [
    ("you are an idiot", {"aimed": 4.0}),
    ("what an idiot", {"bare": 4.0}),
    ("idiot, are you mad", {"aimed": 4.0}),
    ("You. An idiot stood there", {"bare": 4.0}),  # the target's scope ends with its clause
    ("you are not an idiot", {"negated": 4.0}),
    ("she said you are an idiot", {"reported": 4.0}),
    ("She said so. You idiot", {"aimed": 4.0}),
    ('the "idiot" of the village', {"reported": 4.0}),
    ("the “idiot” of the village", {"reported": 4.0}),
    ('an open " mark\nidiot', {"bare": 4.0}),
    ("I will kill you", {"threat": 4.0}),
    ("they kill time", {}),  # no modal before
    ("I will never hurt you", {"negated": 4.0}),
    ("DUMMKOEPFE und Clown", {"bare": 7.0}),  # a stem, and a word
    ("the the the", {}),
])
def test_clauses(text, kinds):
    _, _, sums = BASE.features(text)
    assert {k: s for k, s in zip(KINDS, sums) if s} == kinds


def brute(tokens, options=ToxicityOptions()):
    """Events by looking back and ahead in the list of classes, instead of by states."""
    from graniteseek.llm.toxicity import END, INSULT, LINE, MODAL, NEGATION, QUOTE, REPORT, TARGET, THREAT

    def before(k, kind, reach):
        for j in range(k - 1, -1, -1):
            if tokens[j] in (END, LINE) or (reach is not None and k - j > reach):
                return False
            if tokens[j] == kind:
                return True
        return False

    out, waits = [], None
    for k, kind in enumerate(tokens):
        event = None
        line = max((j for j in range(k) if tokens[j] == LINE), default=-1)
        quoted = sum(t == QUOTE for t in tokens[line + 1 : k]) % 2 == 1
        threat = kind == THREAT and before(k, MODAL, options.modal_reach)
        if kind == INSULT or threat:
            waits = None
            if before(k, REPORT, None) or quoted:
                event = "reported"
            elif before(k, NEGATION, options.negation_reach):
                event = "negated"
            elif threat:
                event = "threat"
            elif before(k, TARGET, options.target_reach):
                event = "aimed"
            else:
                event, waits = "bare", k
        elif kind in (END, LINE):
            waits = None
        elif kind == TARGET and waits is not None and k - waits <= options.late_reach:
            event, waits = "late", None
        out.append(event)
    return out


def test_composed_transducer_equals_the_definition():
    step, events = grammar()
    assert 50 < len(step) < 20_000
    rng = random.Random(3)
    for _ in range(400):
        tokens = [rng.choice([0, 0, 0, *range(10)]) for _ in range(rng.randint(0, 40))]
        state, got = 0, []
        for t in tokens:
            got.append(events[state][t])
            state = int(step[state, t])
        assert got == brute(tokens)


def corpus(rng, n):
    fill = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for _ in range(n):
        words = rng.choices(fill, k=rng.randint(20, 150))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(3, len(words) // 40)):
                words.insert(rng.randint(0, len(words)), rng.choice(["zorgling", "zorglich", "zorgen", "quaffit"]))
        rows.append((" ".join(words), int(toxic)))
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame([(k, 0, y) for k, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")


def test_learns_words_and_stems_and_holds_on_held_out_rows(spark, docs_of):
    rows = corpus(random.Random(2), 800)
    docs = docs_of([t for t, _ in rows])
    model = fit_toxicity(docs, labels_of(spark, rows), ~unlabelled())
    assert "zorg" in model.stems and "quaffit" in model.insults
    found = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    held = [r.doc_id for r in docs.filter(unlabelled()).collect()]
    assert 100 < len(held) < 240
    assert sum(found[k].predicted == rows[k][1] for k in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    kept = {r.doc_id for r in drop_toxic(docs, model).collect()}
    assert kept == {k for k, r in found.items() if not r.predicted}


def test_held_out_labels_are_not_used(spark, docs_of):
    rows = corpus(random.Random(4), 300)
    docs, labels = docs_of([t for t, _ in rows]), labels_of(spark, rows)
    other = labels.withColumn("toxic", F.when(unlabelled(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit_toxicity(docs, x, ~unlabelled()) for x in (labels, other))
    assert a.insults == b.insults and a.stems == b.stems and np.array_equal(a.weights, b.weights)


def test_sample_is_bounded(spark, docs_of):
    rows = corpus(random.Random(5), 200)
    docs, labels = docs_of([t for t, _ in rows]), labels_of(spark, rows)
    from graniteseek.llm.toxicity import labelled_texts

    assert labelled_texts(docs, labels, F.lit(True), ToxicityOptions(sample_rows=50)).count() == 50


def test_odd_rows(spark, docs_of):
    texts = [None, "", " .\n", "you idiot", "you idiot", "the cat " * 60_000 + "you idiot", "𝕏 ½ you Idiot’s"]
    docs = docs_of(texts, ids=[1, 2, 3, 4, 4, None, 7], clashing=True)
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (4, 0, 1), (4, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, labels, ~unlabelled())
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == 7 and len({r.score for r in rows[:2]}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert rows[3].score == rows[4].score > 0.5 > rows[0].score and rows[5].n_clauses == 1
    nothing = fit_toxicity(docs.limit(0), labels.limit(0), ~unlabelled())
    assert np.array_equal(nothing.weights, PRIOR) and score_toxicity(docs.limit(0), nothing).count() == 0
    assert np.array_equal(fit_weights(np.zeros((0, len(PRIOR))), np.zeros(0)), PRIOR)
    assert drop_toxic(docs, nothing).columns == docs.columns
