"""Text functions as Column expressions: JVM-side, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the retrieval tokenizer; accented letters separate, punctuation of identifiers and urls sticks.
RETRIEVAL_TOKEN = r"([a-zA-Z0-9_./:#-]+)"


def retrieval_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(RETRIEVAL_TOKEN), 1), F.array().cast("array<string>"))


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped_label(text: Column, most: int = 160) -> Column:
    """At most `most` characters; longer labels end at the last space before that, with an ellipsis."""
    head = F.substring(text, 1, most)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def truncated(text: Column, tokens: int | None) -> Column:
    """The first tokens under the character tokenizer; no limit if null or not positive."""
    return text if not tokens or tokens < 0 else F.substring(text, 1, tokens)


def heading_of(block: Column) -> Column:
    """The heading text of a block that begins with one to six '#' and white space; else null."""
    found = stripped(F.regexp_extract(block, r"(?s)^#{1,6}\s+(.+)$", 1))
    return F.when(found != "", found)


def xml_text(value: Column) -> Column:
    """Element text: characters that XML forbids go, markup characters are escaped."""
    clean = F.regexp_replace(value, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute(value: Column) -> Column:
    """A quoted attribute value."""
    breaks = xml_text(value)
    for raw, name in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        breaks = F.replace(breaks, F.lit(raw), F.lit(name))
    both = breaks.contains('"') & breaks.contains("'")
    quoted = F.concat(F.lit('"'), F.replace(breaks, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    single = F.concat(F.lit("'"), breaks, F.lit("'"))
    return F.when(both, quoted).when(breaks.contains('"'), single).otherwise(quoted)


def engine_list(names: Column) -> Column:
    """A comma-separated engine list with blanks dropped."""
    return F.array_join(F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != ""), ",")


def first_nonempty(*columns: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*(F.when(stripped(c) != "", stripped(c)) for c in columns))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows as structs (chunk_id, start, text); a step that isn't positive falls back to `size`."""
    step = size - overlap if size > overlap else size
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk_id"), s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))
