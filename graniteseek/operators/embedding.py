"""Dense vectors of texts by an embedder, in Arrow batches; one model session for each Python worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import RETRIEVAL_TOKEN

BATCH = 32


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Hashing:
    """Token counts by hash bucket, scaled to length 1; the same vectors as the column form."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts):
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for token in re.findall(RETRIEVAL_TOKEN, text.lower()):
                row[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimensions] += 1
        return scaled(out)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x, dtype=float), where=size > 0)


POOLING = ("auto", "cls")


def pooled(outputs: dict[str, np.ndarray], normalise: bool = True, pooling: str = "auto") -> np.ndarray:
    """Sentence vectors of a model's outputs.

    auto: one named so or with two axes as it is, else the first token's.  cls: the first token's if there are tokens.
    """
    if pooling not in POOLING:
        raise ValueError(f"pooling is one of {', '.join(POOLING)}")
    named = outputs.get("sentence_embedding")
    two = next((v for v in outputs.values() if v.ndim == 2), None)
    three = next((v for v in outputs.values() if v.ndim == 3), None)
    if pooling == "cls" and three is not None:
        named = two = None
    x = named if named is not None else two if two is not None else three[:, 0] if three is not None else None
    if x is None or x.ndim != 2:
        raise ValueError("no output has one vector a text")
    return scaled(np.asarray(x, float)) if normalise else np.asarray(x, float)


class Onnx:
    """A local ONNX model with its tokenizer file; inputs are padded per batch and cut at `longest` tokens."""

    def __init__(self, model: str, tokenizer: str, longest: int = 512, normalise: bool = True, pooling: str = "auto"):
        self.model, self.tokenizer, self.longest, self.normalise, self.pooling = model, tokenizer, longest, normalise, pooling
        self.loaded = None

    def __getstate__(self):
        return {**self.__dict__, "loaded": None}

    def _load(self):
        if self.loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(self.tokenizer)
            coder.enable_truncation(self.longest)
            coder.enable_padding()
            self.loaded = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"]), coder
        return self.loaded

    def embed(self, texts):
        session, coder = self._load()
        parts = []
        for k in range(0, len(texts), BATCH):
            encoded = coder.encode_batch(list(texts[k : k + BATCH]))
            whole = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
            given = {i.name: np.array(whole[i.name], np.int64) for i in session.get_inputs() if i.name in whole}
            names = [o.name for o in session.get_outputs()]
            parts.append(pooled(dict(zip(names, session.run(names, given))), self.normalise, self.pooling))
        return np.vstack(parts) if parts else np.zeros((0, 0))


_KINDS: dict[str, Callable[..., Embedder]] = {"hashing": Hashing, "onnx": Onnx}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    """A caller's own embedder, e.g. a remote service's client."""
    _KINDS[name] = factory


def embedder(name: str, **options) -> Embedder:
    if name not in _KINDS:
        raise ValueError(f"unknown embedder {name!r}; there are {', '.join(sorted(_KINDS))}")
    return _KINDS[name](**options)


def embed_texts(rows: DataFrame, keys: list[str], text: str, model: Embedder, prefix: str = "") -> DataFrame:
    """keys and `vector` of every row; null texts have null vectors."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            real = [k for k, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            vectors = model.embed([prefix + texts[k] for k in real]) if real else ()
            if len(vectors) != len(real):
                raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(real)} texts")
            for k, v in zip(real, vectors):
                out[k] = v.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return rows.select(*keys, F.col(text)).mapInArrow(run, schema)
