import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteseek.functions.text import retrieval_tokens
from graniteseek.functions.tokenizers import Characters, resolved, tokenizer_for, truncate
from graniteseek.functions.vectors import hash_vectors
from graniteseek.operators.embedding import Hashing, embed_texts, embedder, pooled, register_embedder


def test_pooling():
    assert pooled({"last": np.array([[[3.0, 4.0], [9.0, 9.0]]])}).tolist() == [[0.6, 0.8]]
    assert pooled({"last": np.ones((1, 2, 2)), "sentence_embedding": np.array([[3.0, 4.0]])}, normalise=False).tolist() == [[3.0, 4.0]]
    with pytest.raises(ValueError):
        pooled({"x": np.array([1.0, 2.0])})


def test_registry():
    assert isinstance(embedder("hashing", dimensions=8), Hashing)
    register_embedder("mine", lambda: Hashing(4))
    assert embedder("mine").dimensions == 4
    with pytest.raises(ValueError):
        embedder("llama_cpp")


def test_the_hashing_embedder_equals_its_column_form(spark):
    frame = spark.createDataFrame([(1, "One two two three."), (2, "Öl and b"), (3, None)], "k int, text string")
    got = {r.k: r.vector for r in embed_texts(frame, ["k"], "text", Hashing()).collect()}
    want = {r.k: r.vector for r in hash_vectors(frame.withColumn("tokens", retrieval_tokens(F.col("text"))), ["k"]).collect()}
    assert got[3] is None and all(got[k] == pytest.approx(want[k]) for k in (1, 2))


def test_tokenizers():
    assert isinstance(tokenizer_for(None), Characters) and resolved(None) is None and resolved("/no/such/file") is None
    with pytest.raises(FileNotFoundError):
        tokenizer_for("/no/such/file")
    assert truncate("abcdef", 3, Characters()) == "abc" and truncate("abc", 0, Characters()) == "abc"
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        coder = tokenizer_for(f"/opt/tokenizers/{name}")
        if not isinstance(coder, Characters):
            assert coder.decode(coder.encode("Some text here")) == "Some text here" and len(coder.encode("Some text here")) == 3
