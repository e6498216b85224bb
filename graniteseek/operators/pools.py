"""Scores within bounded pools: a page's blocks or links, a query's results or chunks.

A pool's statistics are its own, so its scores are a matter of its rows alone.  Rows and queries meet once, grouped by
pool, and a group is scored in numpy: one shuffle instead of one for each of tokens, frequencies, means and hits.  The
blocks of a single text are a pool within a row; they need no shuffle at all.  Pools are bounded by what makes them (a
page, or the rows kept of a query); corpora belong to an index (postings.py).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.names import fresh
from ..functions.text import RETRIEVAL_TOKEN
from ..functions.vectors import DIMENSIONS
from .postings import B, K1

EPSILON = 0.25
_TOKEN = re.compile(RETRIEVAL_TOKEN)
_BLOCKS = re.compile(r"\n{2,}")


def bm25_of_pool(documents: list[list[str]], asked: list[str]) -> list[float | None]:
    """The score of each document of a pool for its query; None if it shares no term."""
    counts = [Counter(d) for d in documents]
    df = Counter(t for c in counts for t in c)
    wanted = {t: n for t, n in Counter(asked).items() if t in df}
    if not wanted:
        return [None] * len(documents)
    n, mean = len(documents), sum(map(len, documents)) / len(documents)
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    low = EPSILON * sum(raw.values()) / len(raw)
    weight = {t: times * (low if raw[t] < 0 else raw[t]) for t, times in wanted.items()}
    out: list[float | None] = []
    for d, c in zip(documents, counts):
        hits = [(w, c[t]) for t, w in weight.items() if t in c]
        norm = K1 * (1 - B + B * len(d) / mean) if mean else 0.0
        out.append(sum(w * tf * (K1 + 1) / (tf + norm) for w, tf in hits) if hits else None)
    return out


@lru_cache(1 << 16)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % DIMENSIONS


def hashed_vector(tokens: list[str]) -> np.ndarray | None:
    """Token counts by bucket, scaled to length 1; None without tokens."""
    if not tokens:
        return None
    counts = np.bincount([_bucket(t) for t in tokens], minlength=DIMENSIONS).astype(float)
    return counts / np.sqrt((counts * counts).sum())


def pool_scores(rows: DataFrame, queries: DataFrame, pool: str) -> DataFrame:
    """The rows (pool, tokens, ...) with bm25_score, vector and dense_score for the query (pool, tokens) of their pool.

    Rows without a hit, without tokens or without a query score 0; a row without tokens has no vector.
    """
    extra = [T.StructField("bm25_score", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("dense_score", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *extra])
    arrow = [to_arrow_type(f.dataType) for f in extra]

    def score(group: pa.Table, asked: pa.Table) -> pa.Table:
        documents = [d or [] for d in group.column("tokens").to_pylist()]
        wanted = (asked.column("tokens")[0].as_py() or []) if asked.num_rows else []
        vectors, own = [hashed_vector(d) for d in documents], hashed_vector(wanted)
        columns = [
            [s or 0.0 for s in bm25_of_pool(documents, wanted)],
            [None if v is None else v.tolist() for v in vectors],
            [0.0 if v is None or own is None else float(v @ own) for v in vectors]]
        out = group
        for field, kind, values in zip(extra, arrow, columns):
            out = out.append_column(field.name, pa.array(values, kind))
        return out

    return rows.groupBy(pool).cogroup(queries.select(pool, "tokens").groupBy(pool)).applyInArrow(score, schema)


def with_fit_blocks(rows: DataFrame, asked: Column, threshold: float, markdown: str = "markdown", name: str = "fit") -> DataFrame:
    """The rows with `name`: the blocks of their text whose BM25 against `asked` (an array of tokens) is `threshold` or
    more, in order; null if there is none.  The corpus of a block is its text."""
    query, = fresh(rows, "asked_tokens")
    kept_names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def fit(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(markdown).to_pylist(), batch.column(query).to_pylist()):
                blocks = _BLOCKS.split(text) if text is not None else []
                scores = bm25_of_pool([_TOKEN.findall(b.lower()) for b in blocks], wanted or []) if wanted else []
                kept = [b for b, s in zip(blocks, scores) if s is not None and s >= threshold]
                out.append("\n\n".join(kept) if kept else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept_names), pa.array(out, pa.string())], names=schema.names)

    return rows.withColumn(query, asked).mapInArrow(fit, schema)
