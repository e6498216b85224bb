"""Helpers that several operators share: words, scratch tables, column names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..sources.staging import staged as cut, unstaged as free
from ..sources.tables import bounded_batches

__all__ = ["as_bytes", "ascii_lower", "bounded_batches", "cut", "free", "fresh", "sliced", "table", "words_of"]

#: A-Z lower-cased, 0-9, a-z and all bytes of non-ASCII characters kept, the rest blank.
_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: The same words, for use on a str whose A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(_WORD_TABLE).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds the texts and results of a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
