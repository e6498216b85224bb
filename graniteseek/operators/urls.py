"""Source filters: blocked domains and public-address checks, all Column expressions and joins."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.urls import host_suffixes, is_http, normal_host, url_hostname

MOST_BROADCAST_DOMAINS = 100_000


def blocked_list(spark, domains: Iterable[str]) -> DataFrame:
    """`domain`: normalised, distinct, without empty entries."""
    rows = spark.range(1).select(F.explode(F.lit(list(domains)).cast("array<string>")).alias("d"))
    return rows.select(normal_host(F.col("d")).alias("domain")).filter("domain <> ''").distinct()


def _blocked_hosts(rows: DataFrame, blocked: DataFrame, url: str, name: str) -> DataFrame:
    """`name`: the distinct normalised hosts of the rows that are blocked or below a blocked domain.

    Hosts become their suffixes and meet the list in an equi join: no pair of row and domain is tried.
    """
    hosts = rows.select(normal_host(F.col(url)).alias(name)).distinct()
    small = blocked.limit(MOST_BROADCAST_DOMAINS + 1).count() <= MOST_BROADCAST_DOMAINS
    suffixes = hosts.select(name, F.explode(host_suffixes(F.col(name))).alias("domain"))
    return suffixes.join(F.broadcast(blocked) if small else blocked, "domain", "left_semi").select(name).distinct()


def drop_blocked(rows: DataFrame, blocked: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is no blocked domain and below none.  The outcome for a host goes back to its rows."""
    name, own = fresh(rows, "blocked_host", "own_host")
    return rows.withColumn(own, normal_host(F.col(url))).join(_blocked_hosts(rows, blocked, url, name), F.col(own) == F.col(name), "left_anti").drop(own)


# IPv4 networks that aren't public, and single addresses in them that are.
CLOSED_V4 = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
OPEN_V4 = "192.0.0.9 192.0.0.10".split()
# IPv6 is public in 2000::/3 less these (first two groups from, to), and again in those after.
CLOSED_V6 = (("2001:0000", "2001:01ff"), ("2001:0db8", "2001:0db8"), ("2002:0000", "2002:ffff"))
OPEN_V6 = (("2001:0003", "2001:0003"), ("2001:0020", "2001:003f"))

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _closed_v4(value: Column) -> Column:
    """Whether an IPv4 address, as a number, isn't public."""
    out = F.lit(False)
    for network in map(ipaddress.ip_network, CLOSED_V4):
        out = out | value.between(int(network[0]), int(network[-1]))
    return out & ~value.isin([int(ipaddress.ip_address(x)) for x in OPEN_V4])


def _v4_number(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.")
    return sum((F.get(parts, F.lit(k)).cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), F.get(parts, F.lit(0)).cast("long") * (1 << 24))


def _v6_groups(bare: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null if it has another number of groups."""
    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    left, right = groups(F.substring_index(bare, "::", 1)), groups(F.element_at(F.split(bare, "::"), -1))
    gap = F.lit(8) - F.size(left) - F.size(right)
    short = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    every = F.when(bare.contains("::"), short).otherwise(groups(bare))
    return F.when((F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(every, lambda g: F.conv(g, 16, 10).cast("long")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value as a variable, so that the expression holds it once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _closed_v6(group: Column) -> Column:
    """Whether an IPv6 address, as eight numbers, isn't public."""
    at = lambda k: F.get(group, F.lit(k))
    head = at(0) * (1 << 16) + at(1)
    number = lambda pair: int(pair.replace(":", ""), 16)
    closed = ~at(0).between(0x2000, 0x3FFF)
    for first, last in CLOSED_V6:
        closed = closed | head.between(number(first), number(last))
    for first, last in OPEN_V6:
        closed = closed & ~head.between(number(first), number(last))
    mapped = (F.slice(group, 1, 5) == F.array_repeat(F.lit(0).cast("long"), F.lit(5))) & (at(5) == 0xFFFF)
    return F.when(mapped, _once(at(6) * (1 << 16) + at(7), _closed_v4)).otherwise(closed)


def _is_closed(bare: Column) -> Column:
    dotted = F.regexp_extract(bare, r"^::(ffff:)?([0-9.]+)$", 2)
    embedded = F.when(bare.startswith("::ffff:"), _once(_v4_number(dotted), _closed_v4)).otherwise(True)
    six = F.coalesce(_once(_v6_groups(bare), _closed_v6), F.lit(False))
    return F.when(bare.rlike(_V4), _once(_v4_number(bare), _closed_v4)).when(dotted.rlike(_V4), embedded).when(bare.contains(":"), six).otherwise(False)


def is_private_literal(host: Column) -> Column:
    """Whether a host is an address literal that isn't public; names are not literals."""
    return _once(F.lower(F.substring_index(F.regexp_replace(F.coalesce(host, F.lit("")), r"^\[|\]$", ""), "%", 1)), _is_closed)


def safety_code(url: Column) -> Column:
    """ok, invalid_url (scheme, user info or host) or blocked_url (an address that isn't public)."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    host = F.when(authority.contains("["), F.regexp_extract(authority, r"(\[[^\]]*\])", 1)).otherwise(url_hostname(url))

    def code(u: Column) -> Column:
        bad = u["url"].isNull() | ~is_http(u["url"]) | u["authority"].contains("@") | (u["host"] == "")
        local = F.lower(u["host"]).rlike(r"(^|\.)localhost$")
        blocked = local | F.when(u["host"].rlike(r"^\[|^[0-9.]+$"), is_private_literal(u["host"])).otherwise(False)
        return F.when(bad, "invalid_url").when(blocked, "blocked_url").otherwise("ok")

    return _once(F.struct(url.alias("url"), authority.alias("authority"), host.alias("host")), code)


def all_public(addresses: DataFrame, host: str = "host", address: str = "address") -> DataFrame:
    """host, public: whether every resolved address is public, from a table of resolutions."""
    return addresses.groupBy(host).agg(F.bool_and(~is_private_literal(F.col(address))).alias("public"))


def fetch_code(rows: DataFrame, name: str, url: str = "url", blocked: DataFrame | None = None, dns: DataFrame | None = None) -> DataFrame:
    """The rows with `name`: ok, or why the url may not be fetched.

    In this order: the url's form and address literals, blocked domains, and the host's resolutions (host, address),
    all of which must be public; a host without one can't be fetched (fetch_failed).  Literals need none.
    """
    own, hit, host, public = fresh(rows, "own_host", "hit_host", "dns_host", "dns_public")
    code = safety_code(F.col(url))
    out = rows.withColumn(own, normal_host(F.col(url)))
    if blocked is not None:
        out = out.join(_blocked_hosts(rows, blocked, url, hit), F.col(own) == F.col(hit), "left")
        code = F.when(code != "ok", code).when(F.col(hit).isNotNull(), "blocked_url").otherwise("ok")
    if dns is not None:
        known = all_public(dns).select(F.col("host").alias(host), F.col("public").alias(public))
        name_of = url_hostname(F.col(url))
        out = out.join(known, name_of == F.col(host), "left")
        literal = name_of.rlike(r"^[0-9.]+$") | F.col(url).rlike(r"://[^/?#]*\[")
        code = F.when((code != "ok") | literal, code).when(F.col(public).isNull(), "fetch_failed").when(~F.col(public), "blocked_url").otherwise("ok")
    return out.withColumn(name, code).drop(own, hit, host, public)
