import math
import random
import re
import textwrap

import pytest

from graniteseek.llm.license_scan import PHRASES, TEMPLATES, license_labels, license_links
from graniteseek.llm.queries import op5_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, threshold=0.9):
    """Every run of every text; a narrower template's runs give way to a wider one's that they overlap."""
    sets = [(label, words(t), set(words(t))) for label, t in TEMPLATES]
    out = []
    for doc, text in docs:
        w = words(text)
        places = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        hits = []
        for label, listed, t in sets:
            reach, need = math.floor(len(listed) / threshold + 1e-9), math.ceil(threshold * len(t) - 1e-9)
            for k in range(len(w)):
                run = [j for j in range(max(0, k - reach + 1), k + 1) if w[j] in t]
                if w[k] in t and len({w[j] for j in run}) >= need:
                    hits.append((label, t, run[0], k, len({w[j] for j in run}) / len(t)))
        links = [(h[0], h[4]) for h in hits if not any(h[1] < o[1] and o[2] <= h[3] and o[3] >= h[2] for o in hits)]
        base = {label for _, label in places}
        score = 1.0 if places else max((c for _, c in links), default=0.0)
        at = [k for k, _ in places]
        out.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {label for label, _ in links})), score))
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_matches_brute_force(spark, docs_of, threshold):
    rng = random.Random(9)
    vocabulary = sorted({w for _, t in TEMPLATES for w in words(t)}) + ["xx", "yy"]
    texts = [None, "", "MIT License mit license!", "mit license mit license", "cc by cc by", "Apache\nLicense", "gnu  general-public license"]
    for k in range(120):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = words(rng.choice(TEMPLATES)[1]) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(0, 30))
            line = [w for w in line if rng.random() > 0.05] + rng.choices(vocabulary, k=rng.randint(0, 3))
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    docs = docs_of(texts, clashing=True)
    got = sorted(tuple(r) for r in license_labels(docs, threshold=threshold).collect())
    assert [g[:7] for g in got] == [b[:7] for b in brute(list(enumerate(texts)), threshold)]
    assert [g[7] for g in got] == pytest.approx([b[7] for b in brute(list(enumerate(texts)), threshold)])


def test_links_and_empty_tables(spark, docs_of):
    docs = docs_of(["intro\nReleased under the MIT License. Thanks"])
    row, = license_links(docs).collect()
    assert (row.first_word, row.last_word, row.label, row.containment, row.passage) == (1, 5, "mit", 1.0, "released under the mit license")
    assert license_links(docs.limit(0)).count() == 0 and license_labels(docs.limit(0)).count() == 0
    assert license_labels(docs, templates=()).first().labels == "mit"


def test_a_very_long_text(spark, docs_of):
    row = license_labels(docs_of(["w " * 400000 + "mit license"])).first()
    assert (row.n_base, row.first_word) == (1, 400000)


def test_wrapped_texts_have_their_labels(spark, docs_of, tmp_path):
    full = [(label, t) for label, t in TEMPLATES if len(t) > 80]
    texts = ["Some words before. " + t + " and some after it." for _, t in full]
    texts = ["\n".join(f" * {line}" for line in textwrap.wrap(t, 40)) for t in texts]
    apart = words(full[0][1])  # the same words, far from each other
    docs_of([*texts, ("\n" + "x " * 30).join(apart)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op5_license_scan(spark, str(tmp_path)).collect()}
    for k, (label, _) in enumerate(full):
        assert label in got[k].labels.split(",") and got[k].score == 1.0
    assert (got[len(full)].labels, got[len(full)].score) == ("", 0.0)


def test_line_ends_do_not_matter(spark, docs_of):
    rng = random.Random(10)
    strewn = words(TEMPLATES[10][1]) + [f"x{k}" for k in range(1200)]
    rng.shuffle(strewn)
    full = "intro " + TEMPLATES[10][1] + " outro"
    texts = [" ".join(strewn), "\n".join(" ".join(strewn[k : k + 12]) for k in range(0, len(strewn), 12)), full, "\n".join(full.split())]
    got = [r.labels for r in license_labels(docs_of(texts)).collect()]
    assert got == ["", "", "mit", "mit"]


def test_a_template_within_a_wider_one_gives_way(spark, docs_of):
    texts = ["Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0. " + "word " * 30 + "Licensed under CC BY 4.0", "Licensed under\nCC BY-NC\n4.0"]
    got = [r.labels for r in license_labels(docs_of(texts)).collect()]
    assert got == ["cc-by,cc-by-nc-4.0", "cc-by,cc-by-4.0", "cc-by,cc-by-sa-4.0", "cc-by,cc-by-4.0,cc-by-nc-4.0", "cc-by,cc-by-nc-4.0"]


def test_a_very_long_text_of_phrases_is_linear(spark, docs_of):
    import time

    began = time.time()
    row = license_labels(docs_of(["the MIT license " * 200_000], clashing=True)).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (600_000, 200_000, 1, 599_998) and time.time() - began < 60
