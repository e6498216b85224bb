"""License scan: an exact set-similarity join of text blocks with license templates by containment.

A template is a set of words.  A block is any run of a document's words as long as the template (its words with repeats,
divided by the threshold), wherever lines end; it links to the template if it holds at least `threshold` of its words.
Words are ordered by how many texts of the whole corpus have them, rarest first; words of no template can't add to an
overlap and are left out.  With t words and a need of ceil(threshold * t):

- prefix filter: a text with a linked block has one of the template's first t - need + 1 words;
- length filter: it has at least `need` template words;
- positional filter: from the first shared prefix word on, no more words can be shared than the shorter rest.

Only templates that pass are looked for in the text's runs, by a sliding count of the words held.  A link goes from the
run's first template word to its last.  Where a template's words are a proper subset of another's (`CC BY 4.0` in
`CC BY-NC 4.0`), its links that overlap one of the other's give way: the text says the longer name there.  Places of
fixed phrases are found beside it, word by word.

Scale: two maps over the documents, the first for word frequencies (summed per batch, then by word; at most
the templates' vocabulary is collected), the second for the join.  Templates are a parameter, checked to fit
`template_words`, and the only thing broadcast.  No shuffle of text, no pairs of documents.

Cases: a null text is empty and has no word, place or label.  A text of any length is read whole, in time linear in
its words.  Templates held equally well all give their labels; words of equal frequency are ordered by their bytes.
Repeated rows get a row each; extra columns are ignored; empty tables and templates without words give no links.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, sliced, words_of

THRESHOLD = 0.9
TEMPLATE_WORDS = 1 << 20

# Phrases and the labels they give.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Sentences of public licenses and the labels they give.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl-3.0", "GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def template_sets(templates=TEMPLATES, template_words: int = TEMPLATE_WORDS) -> list[tuple[str, frozenset[bytes], int]]:
    """Label, words and length with repeats of each template."""
    out = [(label, frozenset(words), len(words)) for label, text in templates for words in [words_of(text.encode())]]
    if sum(n for _, _, n in out) > template_words:
        raise ValueError(f"templates have more than {template_words} words; scan with them in parts")
    return [t for t in out if t[1]]


def block_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text="text") -> dict[bytes, int]:
    """In how many of all texts each word of the vocabulary stands."""
    schema = "word binary, blocks long"

    def count(batches):
        for batch in batches:
            found: dict[bytes, int] = {}
            for body in as_bytes(batch.column(text)):
                for word in vocabulary.intersection(words_of(body)):
                    found[word] = found.get(word, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "blocks"])

    rows = docs.select(text).mapInArrow(count, schema).groupBy("word").agg(F.sum("blocks").alias("blocks"))
    return {bytes(r["word"]): r["blocks"] for r in rows.collect()}


class ContainmentIndex:
    """Prefix index of the templates under a global word order."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes], int]], frequencies: dict[bytes, int], threshold: float):
        words = sorted({w for _, t, _ in templates for w in t}, key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(words)}
        self.vocabulary = frozenset(words)
        self.templates = []
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for k, (label, members, length) in enumerate(templates):
            order = sorted(self.rank[w] for w in members)
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            self.templates.append((label, frozenset(order), len(order), need, math.floor(length / threshold + 1e-9)))
            for place, rank in enumerate(order[: len(order) - need + 1]):
                self.prefixes.setdefault(rank, []).append((k, place))
        self.least = min((t[3] for t in self.templates), default=1)
        self.wider = [[j for j, t in enumerate(self.templates) if own[1] < t[1]] for own in self.templates]

    def candidates(self, words: list[bytes]) -> list[int]:
        """Templates that the whole text holds well enough, by the three filters and a check."""
        shared = self.vocabulary.intersection(words)
        if len(shared) < self.least:
            return []
        block = sorted(self.rank[w] for w in shared)
        seen: set[int] = set()
        out = []
        for place, rank in enumerate(block):
            for k, at in self.prefixes.get(rank, ()):
                if k in seen:
                    continue
                seen.add(k)
                _, members, size, need, _ = self.templates[k]
                if len(block) < need or 1 + min(size - at - 1, len(block) - place - 1) < need:
                    continue
                if len(members.intersection(block)) >= need:
                    out.append(k)
        return out

    def runs(self, k: int, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(first word, last word, words held) of every run that holds a template well enough; both ends rise.

        places: (word, rank) of the text's words that some template has.
        """
        _, members, _, need, reach = self.templates[k]
        places = [p for p in places if p[1] in members]
        inside: dict[int, int] = {}
        begin, out = 0, []
        for at, rank in places:
            inside[rank] = inside.get(rank, 0) + 1
            while places[begin][0] <= at - reach:
                gone = places[begin][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                begin += 1
            if len(inside) >= need:
                out.append((places[begin][0], at, len(inside)))
        return out

    def links(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, containment): of runs that overlap each other the first of the best."""
        some = self.candidates(words)
        if not some:
            return []
        rank = self.rank
        places = [(at, rank[w]) for at, w in enumerate(words) if w in rank]
        found = {k: self.runs(k, places) for k in some}
        out = []
        for k in sorted(found):
            wider = [(found[j], [end for _, end, _ in found[j]]) for j in self.wider[k] if found.get(j)]
            group: tuple[int, int, int] | None = None
            until = -1
            for first, last, held in found[k]:
                if any((at := bisect_left(ends, first)) < len(ends) and runs[at][0] <= last for runs, ends in wider):
                    continue
                if group is not None and first <= until:
                    group = max(group, (first, last, held), key=lambda r: r[2])
                else:
                    if group is not None:
                        out.append((k, group[0], group[1], group[2] / self.templates[k][2]))
                    group = (first, last, held)
                until = last
            if group is not None:
                out.append((k, group[0], group[1], group[2] / self.templates[k][2]))
        return out


def phrase_places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place of every phrase."""
    flat = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        at, before, blanks = flat.find(phrase), 0, 0
        while at >= 0:
            blanks += flat.count(b" ", before, at)  # from the last place on, so a text is counted once
            before = at
            out.append((blanks, label))
            at = flat.find(phrase, at + 1)
    return out


def _flat_phrases(phrases) -> list[tuple[bytes, str]]:
    return [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases]


def license_index(docs: DataFrame, text="text", templates=TEMPLATES, threshold=THRESHOLD) -> ContainmentIndex:
    """The templates ordered by the word frequencies of all documents."""
    sets = template_sets(templates)
    return ContainmentIndex(sets, block_frequencies(docs, frozenset(w for _, t, _ in sets for w in t), text), threshold)


def license_links(docs: DataFrame, doc_id="doc_id", text="text", templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """One row per linked block and template: doc_id, first_word, last_word (from 0), template (number), label,
    containment, passage (the block's words)."""
    shipped = docs.sparkSession.sparkContext.broadcast(license_index(docs, text, templates, threshold))
    schema = T.StructType([docs.schema[doc_id], T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("passage", T.StringType())])

    def run(batches):
        for batch in sliced(batches):
            index, out = shipped.value, []
            for doc, body in zip(batch.column(doc_id).to_pylist(), as_bytes(batch.column(text))):
                words = words_of(body)
                for k, first, last, containment in index.links(words):
                    out.append((doc, first, last, k, index.templates[k][0], containment, b" ".join(words[first : last + 1]).decode()))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [batch.schema.field(doc_id).type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def license_labels(docs: DataFrame, doc_id="doc_id", text="text", phrases=PHRASES, templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a phrase, else the best containment of a linked block, else 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((license_index(docs, text, templates, threshold), _flat_phrases(phrases)))
    schema = T.StructType([docs.schema[doc_id]] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")] + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in sliced(batches):
            index, flat = shipped.value
            out: list[list] = [[] for _ in range(7)]
            for body in as_bytes(batch.column(text)):
                words = words_of(body)
                places = phrase_places(words, flat) if words else []
                links = index.links(words)
                base = {label for _, label in places}
                more = {index.templates[link[0]][0] for link in links}
                starts = [at for at, _ in places]
                score = 1.0 if places else max((link[3] for link in links), default=0.0)
                row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score)
                for column, x in zip(out, row):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), *(pa.array(c, t) for c, t in zip(out, kinds))], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)
