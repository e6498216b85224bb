"""Search backends as scans of captured JSON responses, and the fallback between them.

Responses are rows (query_id, body).  Fetching them is left to whoever has a network; a `SearchSource` is anything
that gives such rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import first_nonempty, stripped

RESULT = ["query_id", "result_id", "title", "url", "text", "published_at"]

# The fields that each backend uses, and the names of dates by precedence.
DATES = ("publishedDate", "published_at", "date", "published", "pubdate")
_DATE_FIELDS = ", ".join(f"{d}: string" for d in DATES)
SCHEMAS = {
    "searxng": f"struct<results: array<struct<title: string, url: string, content: string, {_DATE_FIELDS}>>>",
    "ddgs": f"array<struct<title: string, href: string, body: string, {_DATE_FIELDS}>>",
    "brave": f"struct<web: struct<results: array<struct<title: string, url: string, description: string, {_DATE_FIELDS}>>>>",
}
_ROWS: dict[str, Callable[[Column], Column]] = {"searxng": lambda j: j["results"], "ddgs": lambda j: j, "brave": lambda j: j["web"]["results"]}
_FIELDS = {"searxng": ("url", "content"), "ddgs": ("href", "body"), "brave": ("url", "description")}


def published_at(row: Column) -> Column:
    return first_nonempty(*(row[d] for d in DATES))


def parse_results(responses: DataFrame, backend: str, limit: int = 10) -> DataFrame:
    """query_id, result_id (1..), title, url, text, published_at, backend: rows with title and url, in order."""
    url, text = _FIELDS[backend]
    rows = responses.select("query_id", F.posexplode(_ROWS[backend](F.from_json("body", SCHEMAS[backend]))).alias("pos", "r"))
    rows = rows.select("query_id", "pos", stripped(F.coalesce("r.title", F.lit(""))).alias("title"), stripped(F.coalesce(f"r.{url}", F.lit(""))).alias("url"), stripped(F.coalesce(f"r.{text}", F.lit(""))).alias("text"), published_at(F.col("r")).alias("published_at"))
    rows = rows.filter("title <> '' AND url <> ''")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return rows.withColumn("result_id", place).filter(F.col("result_id") <= limit).select(*RESULT, F.lit(backend).alias("backend"))


def unresponsive_engines(responses: DataFrame) -> DataFrame:
    """query_id, engine: names from a list whose entries are names or [name, reason]."""
    items = F.from_json(F.get_json_object("body", "$.unresponsive_engines"), "array<string>")
    item = F.col("item")
    name = F.when(item.startswith("["), F.get_json_object(item, "$[0]")).otherwise(item)
    return responses.select("query_id", F.explode(items).alias("item")).select("query_id", stripped(name).alias("engine")).filter("engine <> ''")


@dataclass(frozen=True)
class Backends:
    """How a configured backend resolves: which sources are tried, in order."""

    primary: str
    fallbacks: tuple[str, ...]


def dispatch(backend: str, fallback: bool = True, keyed: bool = False) -> Backends:
    """Sources to try.  Without fallback only the primary one is; the keyed one needs its key; `auto` goes from
    searxng to ddgs whatever `fallback` says."""
    name = backend.strip().lower()
    if name in ("ddgs", "duckduckgo"):
        return Backends("ddgs", ("brave",) if keyed else ())
    if name == "auto":
        return Backends("searxng", ("ddgs",))
    return Backends("searxng", (("ddgs", "brave") if keyed else ("ddgs",)) if fallback else ())


# Statuses by which a backend says that it won't answer.
REFUSED = (401, 403, 429)


def backend_errors(responses: DataFrame, backend: str) -> DataFrame:
    """query_id, error_code of every response that is an error: backend_blocked if the backend refused (by `status`, if
    there is such a column) or has no results while engines didn't respond; backend_failed for other statuses from 400
    and for bodies that aren't JSON of its form."""
    status = F.col("status") if "status" in responses.columns else F.lit(200)
    found = _ROWS[backend](F.from_json("body", SCHEMAS[backend]))
    unwell = F.coalesce(F.size(F.from_json(F.get_json_object("body", "$.unresponsive_engines"), "array<string>")), F.lit(0))
    code = F.when(status.isin(*REFUSED), "backend_blocked").when(status >= 400, "backend_failed").when(F.col("body").isNull() | found.isNull(), "backend_failed")
    code = code.when((F.size(found) == 0) & (unwell > 0), "backend_blocked")
    return responses.select("query_id", code.alias("error_code")).filter("error_code IS NOT NULL")


def with_fallback(results: dict[str, DataFrame], backends: Backends, queries: DataFrame, errors: dict[str, DataFrame] | None = None) -> DataFrame:
    """For every query the rows of the first source that has any and didn't fail.  One aggregation over all sources: no
    source is asked per query from the driver."""
    order = [backends.primary, *backends.fallbacks]
    frames = []
    rank, best = fresh(results[order[0]], "order", "best")
    for k, b in enumerate(order):
        if b in results:
            rows = results[b]
            if errors and b in errors:
                rows = rows.join(errors[b].select("query_id").distinct(), "query_id", "left_anti")
            frames.append(rows.withColumn(rank, F.lit(k)))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = rows.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    least = F.min(rank).over(Window.partitionBy("query_id"))
    return rows.withColumn(best, least).filter(F.col(rank) == F.col(best)).drop(rank, best)


def search_errors(found: DataFrame, queries: DataFrame, errors: dict[str, DataFrame], backends: Backends) -> DataFrame:
    """query_id, error_code of the queries without rows whose sources failed: the first source's error counts."""
    order = [backends.primary, *backends.fallbacks]
    rows = None
    for k, b in enumerate(order):
        if b in errors:
            part = errors[b].select("query_id", F.struct(F.lit(k).alias("k"), "error_code").alias("e"))
            rows = part if rows is None else rows.unionAll(part)
    empty = queries.select("query_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti")
    if rows is None:
        return empty.select("query_id", F.lit(None).cast("string").alias("error_code")).limit(0)
    return empty.join(rows.groupBy("query_id").agg(F.min("e")["error_code"].alias("error_code")), "query_id")
