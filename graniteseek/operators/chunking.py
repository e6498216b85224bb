"""Structure-aware chunking: blocks, packing to a token limit, windows for oversized blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import windows
from ..functions.tokenizers import Characters, Tokenizer, resolved, tokenizer_for

_BLOCK_END = re.compile(r"(?=\n#{1,6}\s)|\n{2,}")
_HEADING = re.compile(r"^#{1,6}\s+(.+)$", re.S)

CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk_id", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tokens", T.IntegerType())]))


def chunks_of(text: str | None, most: int, overlap: int, tokenizer: Tokenizer = Characters()) -> list[tuple[int, str, str, int]]:
    """(chunk_id, heading, text, tokens) of a text.

    Blocks end before markdown headings and at blank lines.  They are joined while they fit; a chunk carries the
    heading in force when it is closed, so a heading that opens the next chunk is on the one before.
    """
    out: list[tuple[int, str, str, int]] = []
    held: list[str] = []
    heading = ""
    size: Callable[[str], int] = lambda s: len(tokenizer.encode(s))

    def put(body: str) -> None:
        if body:
            out.append((len(out), heading, body, size(body)))

    def close() -> None:
        put("\n\n".join(held))
        held.clear()

    for block in filter(None, map(str.strip, _BLOCK_END.split((text or "").strip()))):
        if m := _HEADING.match(block):
            heading = m[1].strip()
        if size(block) > most:
            close()
            ids = tokenizer.encode(block)
            for at in range(0, len(ids), most - overlap if most > overlap else most):
                put(tokenizer.decode(ids[at : at + most]).strip())
            continue
        if size("\n\n".join([*held, block])) > most:
            close()
        held.append(block)
    close()
    return out


def pack_chunks(rows: DataFrame, text: str, most: int = 300, overlap: int = 80, tokenizer: str | None = None) -> DataFrame:
    """The rows without the text, one for each chunk: chunk_id, heading, chunk_text, tokens.

    tokenizer: a vocabulary file that executors have; characters without one.
    """
    vocabulary = resolved(tokenizer)

    @F.pandas_udf(CHUNKS)
    def chunk(texts: pd.Series) -> pd.Series:
        coder = tokenizer_for(vocabulary)
        return texts.map(lambda t: [dict(zip(("chunk_id", "heading", "text", "tokens"), c)) for c in chunks_of(t, most, overlap, coder)])

    kept = [c for c in rows.columns if c != text]
    exploded = rows.select(*kept, F.explode(chunk(F.col(text))).alias("c"))
    return exploded.select(*kept, "c.chunk_id", "c.heading", F.col("c.text").alias("chunk_text"), "c.tokens")


def window_chunks(rows: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """The rows without the text, one for each overlapping window: chunk_id, start, chunk_text, tokens."""
    kept = [c for c in rows.columns if c != text]
    exploded = rows.select(*kept, F.explode(windows(F.col(text), size, overlap)).alias("c"))
    return exploded.select(*kept, "c.chunk_id", "c.start", F.col("c.text").alias("chunk_text"), F.length("c.text").alias("tokens"))


def pruned(markdown, threshold: float = 0.48):
    """The blocks of a page that look like prose, whatever is asked: their share of letters times their length in words, up to ten
    as one, is `threshold` or more.  Headings stay."""
    def score(block):
        letters = F.length(F.regexp_replace(block, r"[^\p{L}]", "")) / F.greatest(F.length(block), F.lit(1))
        return letters * F.least(F.size(F.split(F.trim(block), r"\s+")) / F.lit(10.0), F.lit(1.0))

    return F.array_join(F.filter(F.split(markdown, r"\n{2,}"), lambda b: (score(b) >= threshold) | b.rlike(r"^#{1,6}\s")), "\n\n")
