"""Documents as files: DOCX by the standard library, PDF if a reader is installed."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def said(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()

    lines = [said(p) for p in body.findall(f"{_W}p")]
    lines += [" | ".join(said(c) for c in row.findall(f"{_W}tc")) for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
    return "\n\n".join(x for x in lines if x.strip(" |"))


def pdf_text(data: bytes) -> str:
    """'## Page i' blocks; empty pages are skipped."""
    from pypdf import PdfReader

    pages = [(k, (p.extract_text() or "").strip()) for k, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]
    return "\n\n".join(f"## Page {k}\n\n{t}" for k, t in pages if t)


def read_document(suffix: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error code)."""
    try:
        if suffix == "docx":
            text = docx_text(data)
        elif suffix == "pdf":
            text = pdf_text(data)
        else:
            return None, "unsupported_document"
    except ImportError:
        return None, "unsupported_document"
    except Exception:
        return None, "fetch_failed"
    return (text, None) if text else (None, "empty_content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error_code of every file below the path."""
    @F.pandas_udf("text string, error_code string")
    def text(suffix: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_document(s, d) for s, d in zip(suffix, data)], columns=["text", "error_code"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", text(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)), F.col("content")).alias("d")).select("path", "d.*")
