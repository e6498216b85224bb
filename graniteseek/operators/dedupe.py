"""Greedy near-duplicate suppression and source quotas over bounded ranked pools.

Acceptance depends on what was accepted before, so a pool is decided as one ordered group.  Pools are a query's
ranked chunks, at most keep * oversample of them: cut them by rank first.  For whole corpora these operators are
the wrong tool.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import RETRIEVAL_TOKEN

_TOKEN = re.compile(RETRIEVAL_TOKEN)


def jaccard_columns(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays as sets: 1 if both are empty, 0 if one is."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    if not a and not b:
        return 1.0
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def token_set(text: str) -> frozenset[str]:
    return frozenset(_TOKEN.findall(text.lower()))


def lexical_survivors(texts: Sequence[str | None], threshold: float) -> list[int]:
    """Positions kept in rank order: none is as similar as `threshold` to one kept before.

    Texts without tokens are compared letter by letter, with each other.  A threshold of 1 or more turns it off.
    """
    if threshold >= 1:
        return list(range(len(texts)))
    kept: list[int] = []
    sets: list[frozenset[str]] = []
    bare: set[str] = set()
    for k, raw in enumerate(texts):
        text = (raw or "").strip()
        tokens = token_set(text)
        if tokens:
            if any(jaccard(tokens, s) >= threshold for s in sets):
                continue
            sets.append(tokens)
        elif text in bare:
            continue
        else:
            bare.add(text)
        kept.append(k)
    return kept


class SemanticGate:
    """Accepts a vector unless its cosine with an accepted one reaches the threshold; names the closest."""

    def __init__(self, threshold: float, enabled: bool = True):
        self.active, self.threshold = enabled and threshold < 1, threshold
        self.accepted: list[tuple[object, np.ndarray]] = []
        self.rejections: dict[int, tuple[float, object]] = {}

    def admits(self, place: int, vector: Iterable[float] | None) -> bool:
        if not self.active or vector is None or not len(v := np.asarray(vector, float)):
            return True
        best, match = 0.0, None
        for name, other in self.accepted:
            n = min(len(v), len(other))  # the shorter length counts
            a, b = np.linalg.norm(v[:n]), np.linalg.norm(other[:n])
            c = float(v[:n] @ other[:n] / (a * b)) if a and b else 0.0
            if c > best:
                best, match = c, name
        if best >= self.threshold:
            self.rejections.setdefault(place, (best, match))
            return False
        return True

    def accept(self, name: object, vector: Iterable[float] | None) -> None:
        if vector is not None and len(v := np.asarray(vector, float)):
            self.accepted.append((name, v))


def choose(names: Sequence, texts: Sequence[str | None], sources: Sequence[str | None], vectors: Sequence, limit: int, per_source: int, lexical: float, semantic: float, semantic_enabled: bool = True):
    """(chosen positions in order of choice, whether by the quota pass, rejections by position)."""
    gate = SemanticGate(semantic, semantic_enabled)
    ranked = lexical_survivors(texts, lexical)
    chosen: list[tuple[int, bool]] = []
    taken: set[int] = set()
    counts: dict[str, int] = {}

    def sweep(quota: int | None) -> None:
        for k in ranked:
            if len(chosen) >= limit:
                return
            source = sources[k] or ""
            if k in taken or quota is not None and counts.get(source, 0) >= quota or not gate.admits(k, vectors[k]):
                continue
            counts[source] = counts.get(source, 0) + 1
            taken.add(k)
            chosen.append((k, quota is not None))
            gate.accept(names[k], vectors[k])

    if per_source > 0:
        sweep(per_source)
    sweep(None)
    return chosen, gate.rejections


def select_with_quota(pools: DataFrame, pool: str, limit: int, per_source: int = 4, lexical: float = 0.92, semantic: float = 0.92, semantic_enabled: bool = True, name="chunk_id", text="text", source="source_url", vector="vector", rank="rank") -> DataFrame:
    """One row per ranked row: its columns without the vector, plus status (accepted, lexical_duplicate,
    semantic_duplicate, not_needed), selected (1.. in order of choice), similarity and matched (of a rejection)."""
    fields = [f for f in pools.schema.fields if f.name != vector]
    extra = [("status", T.StringType()), ("selected", T.IntegerType()), ("similarity", T.DoubleType()), ("matched", T.StringType())]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in extra])
    limit = max(0, limit)

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(rank, kind="stable").reset_index(drop=True)
        names, texts = group[name].tolist(), group[text].tolist()
        chosen, rejected = choose(names, texts, group[source].tolist(), group[vector].tolist(), limit, per_source, lexical, semantic, semantic_enabled)
        order = {k: n for n, (k, _) in enumerate(chosen, 1)}
        survivors = set(lexical_survivors(texts, lexical))
        status = ["accepted" if k in order else "lexical_duplicate" if k not in survivors else "semantic_duplicate" if k in rejected else "not_needed" for k in range(len(group))]
        out = group.drop(columns=[vector]).assign(status=status)
        out["selected"] = pd.array([order.get(k) for k in range(len(group))], "Int32")
        hit = [rejected.get(k) if k not in order else None for k in range(len(group))]
        out["similarity"] = pd.array([h and h[0] for h in hit], "Float64")
        out["matched"] = [str(h[1]) if h and h[1] is not None else None for h in hit]
        return out[schema.names]

    return pools.groupBy(pool).applyInPandas(decide, schema)
