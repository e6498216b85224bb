"""From raw documents to packed token rows, in five stages.

Each stage works on all documents that the one before kept, written as Parquet and read again.  All but the last
return the columns of documents, extra ones included, whatever their names.

Cases, by stage.  Null and empty texts: language ID drops them; given to the other stages alone, near-dedup keeps null
texts and one of equal empty texts, decontamination keeps them, mixing and packing take none.  Very long texts are read
whole by every stage.  Repeated rows are copies to near-dedup and stay rows of their own elsewhere.  A null doc_id,
lang or source is a value like others; without any lang, language ID keeps every text with a letter.  Ties: near-dedup
keeps the least doc_id, language ID takes the first language by name; mixing's order is a hash.  Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graniteseek.llm.decontaminate import drop_contaminated
from graniteseek.llm.mixing import take_mix
from graniteseek.llm.order_minhash import drop_near_duplicates
from graniteseek.llm.packing import pack_documents
from graniteseek.llm.queries import keep_known_languages
from graniteseek.llm.shared import bounded_batches, cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language; texts without letters and those no language explains go."""
    bounded_batches(spark)
    return keep_known_languages(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    bounded_batches(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    bounded_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    bounded_batches(spark)
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    bounded_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_copies),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
    ("pack_tokens", pack),
]

#: Code lengths, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
