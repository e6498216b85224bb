"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP = r"(?i)^https?://"


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(HTTP), F.lit(False))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_hostname(url: Column) -> Column:
    """The lower-cased host of an absolute url without user info and port; '' if there is none."""
    bare = F.regexp_replace(_authority(url), r"^[^@]*@", "")
    return F.lower(F.regexp_replace(bare, r":[0-9]*$", ""))


def url_domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(F.coalesce(url_hostname(url), F.lit("")), r"^www\.", "")


def normal_host(value: Column) -> Column:
    """A host from a url or a bare host: lower case, no www., no final dots; '' if white space is inside."""
    clean = F.lower(F.trim(value))
    host = F.when(clean.contains("://"), url_hostname(clean)).otherwise(F.regexp_replace(F.regexp_extract(clean, r"^([^/?#]*)", 1), r":[0-9]*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(value.isNull() | clean.rlike(r"\s"), F.lit("")).otherwise(host)


def canonical_url(url: Column) -> Column:
    """Scheme and authority lower-cased, path '/' if empty, fragment dropped; null if not http(s) or without host."""
    scheme, authority = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1)), F.lower(_authority(url))
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    whole = F.concat(scheme, F.lit("://"), authority, F.when(path == "", "/").otherwise(path), query)
    return F.when(is_http(url) & (authority != ""), whole)


def path_suffix(url: Column) -> Column:
    """The lower-cased ending of the path's last segment; '' without one."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_document(url: Column) -> Column:
    return path_suffix(url).isin("pdf", "docx", "doc")


def host_suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def resolved(base: Column, href: Column) -> Column:
    """An href against its page: absolute, //host, /rooted, ?query, #fragment and plain relative forms."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    folder = F.concat(root, F.when(path.contains("/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise("/"))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, _without_dots(href)))
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(root, _without_dots(F.concat(F.regexp_replace(folder, r"^[a-zA-Z]+://[^/]*", ""), href)))))


def _without_dots(path: Column) -> Column:
    """'.' and '..' segments of a rooted path resolved."""
    tail = F.regexp_extract(path, r"([?#].*)$", 1)
    parts = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == ".", acc).when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.array_append(acc, p)))
    closing = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), closing, tail)
