import math
import random

import numpy as np
import pytest

from graniteseek.llm.language_id import PpmOptions, fit_ppm, keep_identified, labelled_sample, predict_language, reject_limit
from graniteseek.llm.queries import held_out, keep_known_languages


def brute_bits(samples, text, order):
    """Code length by the definition: longest kept context first, escapes with exclusion, on plain dicts."""
    counts = {}
    for t in samples:
        for k in range(len(t)):
            for j in range(min(order, k) + 1):
                counts.setdefault(t[k - j : k], {}).setdefault(t[k], 0)
                counts[t[k - j : k]][t[k]] += 1

    def chances(context):
        shorter = chances(context[1:]) if context else [1 / 256] * 256
        seen = counts.get(context)
        if not seen:
            return shorter
        total, distinct = sum(seen.values()), len(seen)
        rest = sum(p for b, p in enumerate(shorter) if b not in seen)
        whole = total + distinct if rest > 0 else total
        return [seen[b] / whole if b in seen else distinct / whole * shorter[b] / rest for b in range(256)]

    return sum(-math.log2(chances(text[max(0, k - order) : k])[text[k]]) for k in range(len(text)))


def test_code_lengths_are_those_of_the_definition():
    samples = {"a": [b"abracadabra " * 5, b"cad " * 3], "b": [b"xyzzy plugh " * 5]}
    # contexts seen once are pruned, so they are given twice
    samples = {k: v * 2 for k, v in samples.items()}
    model = fit_ppm(samples, PpmOptions(order=3, states=10_000))
    for text in (b"", b"abra", b"plugh cad", b"\xff\x00 unseen", b"abracadabra " * 60):
        got = model.code_lengths([text])[0]
        for k, language in enumerate(model.languages):
            assert got[k] == pytest.approx(brute_bits(samples[language], text, 3), rel=1e-4, abs=1e-3)


def test_batches_do_not_matter():
    rng = random.Random(1)
    model = fit_ppm({"a": [b"the cat sat on the mat " * 20], "b": [b"der hund und die katze " * 20]})
    texts = [bytes(rng.choices(b"thecatundr ", k=rng.randint(0, 2000))) for _ in range(40)]
    whole = model.code_lengths(texts)
    assert np.array_equal(whole, np.vstack([model.code_lengths([t]) for t in texts]))


def corpus(rng, n):
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das nicht ist ein mit für auf".split(), "fr": "le la les des est que dans une pour être".split()}
    rows = []
    for _ in range(n):
        lang = rng.choice(list(words))
        rows.append((" ".join(rng.choices(words[lang], k=rng.randint(1, 60))), lang))
    return rows


def test_held_out_accuracy(spark, docs_of):
    rows = corpus(random.Random(4), 400)
    docs = docs_of([t for t, _ in rows], langs=[g for _, g in rows])
    options = PpmOptions()
    model = fit_ppm(labelled_sample(docs, ~held_out(), "doc_id", "text", "lang", options), options)
    got = {r.doc_id: r for r in predict_language(docs, model).collect()}
    held = {r.doc_id for r in docs.filter(held_out()).collect()}
    assert 80 < len(held) < 200
    assert sum(got[k].lang_pred == rows[k][1] for k in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark, docs_of):
    rows = corpus(random.Random(4), 120)
    docs = docs_of([t for t, _ in rows], langs=[g for _, g in rows])
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(held_out(), "zz").otherwise(F.col("lang"))).withColumn("text", F.when(held_out(), "zzz").otherwise(F.col("text")))
    samples = [labelled_sample(d, ~held_out(), "doc_id", "text", "lang", PpmOptions()) for d in (docs, other)]
    assert samples[0] == samples[1]


def test_odd_rows(spark, docs_of):
    texts = [None, "", "123 !?", "the the", "ß" * 100000, "the of and"]
    docs = docs_of(texts, ids=[1, 2, 3, 4, None, 4], langs=["en", None, "de", "en", "de", "en"], clashing=True)
    model = fit_ppm({"en": [b"the of and the of "], "de": ["straße ß ß ".encode()]})
    rows = predict_language(docs, model).collect()
    assert [(r.lang_pred, r.score) for r in rows[:3]] == [("und", 0.0)] * 3 and [r.lang_pred for r in rows[3:]] == ["en", "de", "en"]
    kept = keep_identified(docs, model, 12.0)
    assert kept.columns == docs.columns and kept.count() == 3
    nothing = fit_ppm({})
    assert {r.lang_pred for r in predict_language(docs, nothing).collect()} == {"und"}
    assert sorted(str(r.doc_id) for r in keep_identified(docs, nothing, 1.0).collect()) == ["4", "4", "None"]
    assert predict_language(docs.limit(0), model).count() == 0
    assert labelled_sample(docs.limit(0), ~held_out(), "doc_id", "text", "lang", PpmOptions()) == {}


def test_junk_goes_and_clean_texts_stay(spark, docs_of):
    rng = random.Random(9)
    rows = corpus(rng, 500)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    junk = ["".join(rng.choices("0123456789abcdef", k=200)) for _ in range(10)] + ["".join(rng.choices(letters, k=300)) for _ in range(10)]
    junk += ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(80)) for _ in range(10)] + [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40)) for _ in range(10)]
    docs = docs_of([t for t, _ in rows] + junk, langs=[g for _, g in rows] + [None] * len(junk))
    kept = {r.doc_id for r in keep_known_languages(docs).collect()}
    assert not kept & set(range(500, 540)) and len(kept) >= 499
    unlabelled = docs_of([t for t, _ in rows[:20]] + ["12 !"], langs=[None] * 21)
    assert {r.doc_id for r in keep_known_languages(unlabelled).collect()} == set(range(20))
    assert keep_known_languages(docs.limit(0)).count() == 0


def test_samples_are_bounded_before_they_are_collected(spark, docs_of):
    docs = docs_of(["x" * 100] * 300, langs=["en"] * 200 + ["de"] * 100)
    options = PpmOptions(bytes_per_language=1000, rows_per_language=1000)
    found = labelled_sample(docs, ~held_out(), "doc_id", "text", "lang", options)
    assert {k: len(v) for k, v in found.items()} == {"en": 10, "de": 10}
    assert reject_limit(fit_ppm({}), found) == float("inf")


def test_only_letters_make_a_language(spark, docs_of):
    import unicodedata

    model = fit_ppm({"en": [b"the of and the of "], "de": ["straße ß ß ".encode()]})
    texts = ["½ ² 12", "Ⅷ", "①②", "٣ ४", "_ __", "ª", "字", "ǅ", "ʰ", "́"]
    got = [r.lang_pred for r in predict_language(docs_of(texts), model).collect()]
    assert [g == "und" for g in got] == [not any(unicodedata.category(c).startswith("L") for c in t) for t in texts]


def test_a_repeated_row_trains_once(spark, docs_of):
    docs = docs_of(["the cat " * 5] * 500 + ["der hund"], ids=[7] * 500 + [8], langs=["en"] * 500 + ["de"])
    from pyspark.sql import functions as F

    found = labelled_sample(docs, F.lit(True), "doc_id", "text", "lang", PpmOptions(rows_per_language=1000))
    assert {k: len(v) for k, v in found.items()} == {"en": 1, "de": 1}


def everything_counts(rng):
    """More texts, bytes and long texts than a sample took, in two languages of very different size."""
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das nicht ist ein mit für auf".split()}
    texts = [(" ".join(rng.choices(words["en"], k=rng.randint(100, 500))), "en") for _ in range(700)]
    texts += [(" ".join(rng.choices(words["de"], k=rng.randint(1, 40))), "de") for _ in range(60)]
    return texts + [("rare zebra quagga " * 4000, "en"), ("", "en"), (None, "de"), ("", "xx"), ("kein", None)]


def test_the_model_is_that_of_all_labelled_texts(spark, docs_of):
    from graniteseek.llm.language_id import fit_language_model
    from pyspark.sql import functions as F

    rows = everything_counts(random.Random(5))
    docs = docs_of([t for t, _ in rows], langs=[g for _, g in rows], clashing=True)
    samples = {g: [t.encode() for t, h in rows if h == g and t] for g in ("en", "de")}
    assert sum(map(len, samples["en"])) > 2 * PpmOptions().bytes_per_language
    model = fit_language_model(docs.repartition(5), F.lit(True))
    assert model.languages == ["de", "en"]
    for text in (b"the of quagga zebra", "für und die".encode(), b"\xff\x00 unseen"):
        got = model.code_lengths([text])[0]
        for k, language in enumerate(model.languages):
            assert got[k] == pytest.approx(brute_bits_of(samples[language], text, 5), rel=1e-4, abs=1e-2)


def brute_bits_of(texts, text, order):
    """`brute_bits`, counting only the contexts that the text meets."""
    counts = {}
    for k in range(len(text) + 1):
        for j in range(min(order, k) + 1):
            counts.setdefault(text[k - j : k], {})
    for t in texts:
        for context, after in counts.items():
            at = t.find(context)
            while 0 <= at < len(t) - len(context):
                c = t[at + len(context)]
                after[c] = after.get(c, 0) + 1
                at = t.find(context, at + 1)

    def chances(context):
        shorter = chances(context[1:]) if context else [1 / 256] * 256
        seen = counts[context]
        if not seen:
            return shorter
        total, distinct = sum(seen.values()), len(seen)
        rest = sum(p for b, p in enumerate(shorter) if b not in seen)
        whole = total + distinct if rest > 0 else total
        return [seen[b] / whole if b in seen else distinct / whole * shorter[b] / rest for b in range(256)]

    return sum(-math.log2(chances(text[max(0, k - order) : k])[text[k]]) for k in range(len(text)))


def test_contexts_kept_are_the_best_of_all_texts(spark, docs_of):
    from graniteseek.llm.language_id import fit_language_model
    from pyspark.sql import functions as F

    rows = everything_counts(random.Random(6))
    docs = docs_of([t for t, _ in rows], langs=[g for _, g in rows])
    samples = {g: [t.encode() for t, h in rows if h == g and t] for g in ("en", "de")}
    options = PpmOptions(order=4, states=150, bytes_per_language=20_000)
    sizes = {g: sum(map(len, t)) for g, t in samples.items()}
    n, weight = {}, {}
    for g, texts in samples.items():
        for t in texts:
            for size in range(1, options.order + 1):
                for k in range(len(t) - size + 1):
                    c = t[k : k + size]
                    n[c] = n.get(c, 0) + 1
                    weight[c] = weight.get(c, 0) + min(1, options.bytes_per_language / sizes[g])
    best = sorted((w for c, w in weight.items() if n[c] > 1), reverse=True)
    want = {c for c, w in weight.items() if n[c] > 1 and w > best[options.states] * (1 + 1e-9)}
    for model in (fit_language_model(docs, F.lit(True), options=options), fit_ppm(samples, options)):
        step = model.step.reshape(-1, model.stride)
        assert len(step) == len(want) + 1
        # each context has a state of its own, other than that of its end
        byte = {b: int(model.classes[b]) for b in range(256)}

        def state(context):
            at = 0
            for b in context:
                at = step[at, byte[b]]
            return at

        assert len({state(c) for c in want} | {0}) == len(want) + 1
    whole, local = fit_language_model(docs, F.lit(True), options=options), fit_ppm(samples, options)
    assert np.array_equal(whole.step, local.step) and np.array_equal(whole.cost, local.cost)


def test_the_limit_is_that_of_all_labelled_texts(spark, docs_of):
    from graniteseek.llm.language_id import calibrated_limit
    from pyspark.sql import functions as F

    rng = random.Random(7)
    model = fit_ppm({"en": [b"the of and to in is that it was for " * 50], "de": ["der die und das nicht ist ein mit für auf ".encode() * 50]})
    rows = [(t, g) for t, g in corpus(rng, 700) if g != "fr"] + [("".join(rng.choices("qxzjvk", k=200_000)), "en") for _ in range(20)] + [("12", "en"), (None, "de"), ("x", "zz"), ("x", None)]
    docs = docs_of([t for t, _ in rows], langs=[g for _, g in rows])
    held = {r.doc_id for r in docs.filter(held_out()).collect()}
    samples = {}
    for k, (t, g) in enumerate(rows):
        if k in held and t and g:
            samples.setdefault(g, []).append(t.encode())
    options = PpmOptions(plain_bits=0.0)
    assert calibrated_limit(docs, held_out(), model, options=options) == pytest.approx(reject_limit(model, samples, options), abs=2.1 / 1024)
    assert calibrated_limit(docs, F.lit(False), model) == calibrated_limit(docs, held_out(), fit_ppm({})) == float("inf")


def test_repeated_rows_train_and_calibrate_once(spark, docs_of):
    from graniteseek.llm.language_id import calibrated_limit, fit_language_model
    from pyspark.sql import functions as F

    once = docs_of(["the cat sat on the mat " * 5, "der hund und die katze " * 5, "the dog"], ids=[7, 8, 9], langs=["en", "de", "en"])
    again = once.union(once.filter("doc_id < 9")).union(once.filter("doc_id = 7"))
    models = [fit_language_model(d, F.lit(True)) for d in (once, again)]
    assert np.array_equal(models[0].cost, models[1].cost)
    options = PpmOptions(plain_bits=0.0)
    assert len({calibrated_limit(d, F.lit(True), models[0], options=options) for d in (once, again)}) == 1


def test_places_are_counted_by_language_state_and_class():
    from graniteseek.llm import language_id as m

    auto = m.Automaton([np.zeros(1, np.int64), np.arange(256)], np.arange(256, dtype=np.uint16), 256)
    parts = [([b"abab" * 100, b"ba"], np.array([0, 1])), ([b"a" * 5_000_000], np.array([1]))]
    got = {}
    for cells, n in m.Counts(auto, 2).summed(iter(parts)):
        for c, k in zip(cells.tolist(), n.tolist()):
            got[c] = got.get(c, 0) + k
    size = auto.states * auto.stride
    a, b = ord("a"), ord("b")
    assert got == {a: 1, (1 + a) * 257 + b: 200, (1 + b) * 257 + a: 199, size + b: 1, size + (1 + b) * 257 + a: 1, size + a: 1, size + (1 + a) * 257 + a: 4_999_999}


def test_no_labelled_text_is_left_out(spark, docs_of):
    import zlib

    from graniteseek.llm.queries import fitted_language_model

    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1][:20]
    texts = ["the of and to in is " * 5] * 19 + ["ein langer text mit vielen worten " * 2000]
    assert fitted_language_model(docs_of(texts, ids=ids, langs=["en"] * 19 + ["de"])).languages == ["de", "en"]
