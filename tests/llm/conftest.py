import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Extra columns named as operators name theirs.
CLASHING = ["size", "cls", "KEYS", "copies", "taken", "tag", "hit_ranges", "word_count", "identified", "class_id", "kept_id", "score", "labels", "mixed", "block", "chance", "id", "root", "a", "b"]


@pytest.fixture()
def docs_of(spark):
    def make(texts, langs=None, sources=None, ids=None, clashing=False):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts))]
        frame = spark.createDataFrame(rows, DOCS)
        if clashing:
            from pyspark.sql import functions as F

            frame = frame.withColumns({c: F.lit(7) for c in CLASHING})
        return frame

    return make
