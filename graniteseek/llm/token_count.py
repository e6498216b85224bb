"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A text is cut into leaves of about `leaf_chars` at places where the pre-token pattern always ends a match whatever
stands around: after a letter before anything else, after a digit before anything else, and after any other mark
before white space.  So the leaves' counts add up to the text's in every script; only a single pre-token (a run of
letters or digits without a break) is never cut.  The tree holds sums of characters and tokens.  An edit finds its
leaves by offset, re-encodes those, plus a neighbour when it touches the characters around a cut, and updates the sums
above; everything else keeps its count.  A long insertion is cut into leaves of its own.

Trees are two integer arrays a document (`leaf_chars`, `leaf_tokens`), so a later job can count new edits
without encoding the old text again: `build_trees`, then `recount`.

Scale: maps over documents with no shuffle; memory is one document and its tree.

Cases: a null text counts 0 and has no edits; an empty text has one empty leaf.  Texts and runs of one character may
be of any length.  Edits apply in order, each in offsets of the text that the ones before have left, and are clipped
to it; null edits mean none.  Two edits at one place apply one after the other.  Repeated rows count each; an empty
table gives none.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import sliced
from .tokenizer import DEFAULT_VOCABULARY, encode, encoding, read_vocabulary

LEAF_CHARS = 256

Edit = tuple[int, int, str]


@cache
def cut_pattern() -> re.Pattern:
    """Where a pre-token always ends, by the tokenizer's own letters and digits, which are those of its Unicode version."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))

    def members(kind: str) -> str:
        # a pattern that knows only one kind of character keeps only those
        only = tiktoken.Encoding(kind, pat_str=kind + "+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        points = sorted(map(ord, only.decode(only.encode_ordinary(every))))
        begins = [points[0]] + [b for a, b in zip(points, points[1:]) if b != a + 1]
        ends = [a for a, b in zip(points, points[1:]) if b != a + 1] + [points[-1]]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends))

    letters, digits = members(r"\p{L}"), members(r"\p{N}")
    return re.compile(rf"(?<=[{letters}])(?![{letters}])|(?<=[{digits}])(?![{digits}])|(?<=\S)(?=[ \t\r\n])")


def leaves_of(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """The text in leaves that end where a pre-token always ends."""
    out, begin = [], 0
    while len(text) - begin > leaf_chars:
        m = cut_pattern().search(text, begin + leaf_chars)
        if not m or m.start() >= len(text):
            break
        out.append(text[begin : m.start()])
        begin = m.start()
    return [*out, text[begin:]]


class TokenTree:
    """Sums of characters and tokens over the leaves of a text."""

    def __init__(self, leaves: list[str], tokens: list[int], count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self.count, self.leaf_chars, self.reencoded = count, leaf_chars, 0
        self._grow(leaves, tokens)

    def _grow(self, leaves: list[str], tokens: list[int]) -> None:
        """Sums over the leaves; none is encoded."""
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars = [0] * self.size + [len(x) for x in leaves] + [0] * (self.size - len(leaves))
        self.tokens = [0] * self.size + tokens + [0] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS) -> TokenTree:
        leaves = leaves_of(text, leaf_chars)
        return cls(leaves, [count(x) for x in leaves], count, leaf_chars)

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that has the character at the offset, and where the leaf begins."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if offset >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.size
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replaces the characters of [start, stop) and re-encodes what that can change."""
        whole = self.chars[1]
        start = min(max(start, 0), whole)
        stop = min(max(stop, start), whole)
        # the cut before the region needs its two characters untouched, and so does the cut after it
        first, begin = self._leaf_at(max(start - 1, 0))
        last, last_begin = self._leaf_at(min(stop, max(whole - 1, 0)))
        while first and start < begin + 1:
            first -= 1
            begin -= len(self.leaves[first])
        end = last_begin + len(self.leaves[last])
        while end < whole and stop > end - 1:
            last += 1
            end += len(self.leaves[last])
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - begin] + replacement + region[stop - begin :]
        parts = leaves_of(region, self.leaf_chars)
        counts = [self.count(part) if part else 0 for part in parts]
        slots = last - first + 1
        if len(parts) <= slots:  # empty leaves hold nothing
            for k in range(slots):
                self._put(first + k, *((parts[k], counts[k]) if k < len(parts) else ("", 0)))
        else:
            tokens = self.tokens[self.size : self.size + len(self.leaves)]
            self._grow(self.leaves[:first] + parts + self.leaves[last + 1 :], tokens[:first] + counts + tokens[last + 1 :])
        self.reencoded += len(region)


def build_trees(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, doc_id="doc_id", text="text", leaf_chars=LEAF_CHARS) -> DataFrame:
    """One row per document row: doc_id, n_tokens, leaf_chars, leaf_tokens."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = T.StructType([docs.schema[doc_id], T.StructField("n_tokens", T.LongType()), T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        coder = encoding(shipped.value)
        for batch in sliced(batches):
            chars, tokens = [], []
            for body in batch.column(text):
                leaves = leaves_of(body.as_py(), leaf_chars) if body.is_valid else []
                chars.append([len(x) for x in leaves])
                tokens.append([len(encode(coder, x)) for x in leaves])
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(map(sum, tokens), pa.int64()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text", T.StringType())]))


def recount(docs: DataFrame, edits: str | Callable[[str], list[Edit]], vocabulary: str = DEFAULT_VOCABULARY, doc_id="doc_id", text="text", leaf_chars: str | None = None, leaf_tokens: str | None = None) -> DataFrame:
    """Counts before and after edits: doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_reencoded,
    and the new tree (leaf_chars, leaf_tokens).

    edits: a column of (start, stop, text) structs, or a function that gives the edits of a text.
    leaf_chars, leaf_tokens: columns of `build_trees`; without them, trees are built on the way.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = T.StructType([docs.schema[doc_id]] + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded")] + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("leaf_chars", "leaf_tokens")])
    inputs = [doc_id, text, *([edits] if isinstance(edits, str) else []), *([leaf_chars, leaf_tokens] if leaf_chars else [])]

    def run(batches):
        coder = encoding(shipped.value)

        def count(x: str) -> int:
            return len(encode(coder, x))

        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            given = batch.column(edits).to_pylist() if isinstance(edits, str) else None
            kept = list(zip(batch.column(leaf_chars).to_pylist(), batch.column(leaf_tokens).to_pylist())) if leaf_chars else None
            for k, body in enumerate(batch.column(text)):
                tree = None
                todo: list[Edit] = []
                if body.is_valid:
                    whole = body.as_py()
                    if kept:
                        leaves, at = [], 0
                        for n in kept[k][0]:
                            leaves.append(whole[at : at + n])
                            at += n
                        tree = TokenTree(leaves, list(kept[k][1]), count)
                    else:
                        tree = TokenTree.of(whole, count)
                    todo = edits(whole) if given is None else [(e["start"], e["stop"], e["text"] or "") for e in given[k] or []]
                before = tree.total() if tree else 0
                for e in todo:
                    tree.edit(*e)
                row = (before, len(todo), tree.total(), tree.chars[1], tree.reencoded, [len(x) for x in tree.leaves], tree.tokens[tree.size : tree.size + len(tree.leaves)]) if tree else (0, 0, 0, 0, 0, [], [])
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), *(pa.array(c, pa.int64()) for c in out[:5]), *(pa.array(c, pa.list_(pa.int32())) for c in out[5:])], names=schema.names)

    return docs.select(*(F.col(c) for c in inputs)).mapInArrow(run, schema)


#: Long digit runs, dotted addresses and hex secrets, as a scrubbing pass would take out.
_SCRUB = re.compile(r"\b[0-9a-f]{32,}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\d{7,}|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


def scrub_edits(text: str) -> list[Edit]:
    """Edits that replace personal numbers, addresses and secrets by a mark, in order of place."""
    out, shift = [], 0
    for m in _SCRUB.finditer(text):
        out.append((m.start() + shift, m.end() + shift, "[removed]"))
        shift += len("[removed]") - (m.end() - m.start())
    return out
