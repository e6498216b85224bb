"""URL filter by a Bloom filter cascade, on DataFrame functions only.

Listed keys are `host/path` prefixes.  The keys a url could match are made of its host's suffixes and its path's
prefixes of the sizes that listed keys have.  All such keys of the corpus are the universe.  Level 1 of the cascade
encodes the listed keys; level 2 encodes the universe's unlisted keys that level 1 lets through by mistake; level 3
the listed keys that level 2 lets through; and so on until a level lets none through.  The first level without a key
decides: an even level means listed, an odd one not.  So membership is exact for every key of the universe, and no
url is joined with a list.

A filter is an array of 64-bit words.  A key sets `hashes` bits in one filter; the bits of all keys are combined by
OR per word, with partial sums on the map side.  Filters reach the rows as scalar subqueries.

Scale: the universe is a distinct over short keys with map-side combining, so a host with a third of all pages is one
key a task.  A level has ten bits for each key; levels shrink geometrically.  The listed keys must number
`most_keys` or fewer for the filters to fit (32 MB at the default); more are refused, to be filtered in parts.

Rules and listed keys come as a few values or as tables of any size up to that.  A url is tried against one key for each
shape of listed keys (labels of the host, characters of the path); there may be `most_shapes` of them.

Cases: a null url, or one without ://, has host and path '' and matches no key.  Urls, hosts and paths of any length
are matched.  Repeated urls get a row each and repeated keys count once; extra columns are ignored; an empty list blocks
nothing and an empty table gives no rows.  Keys are matched byte for byte after A-Z of the host are lower-cased.  Two
fitting rules of one length are the same rule; one given with both verdicts blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bloom_filter, bloom_holds, bloom_words
from .shared import ascii_lower, cut

MOST_KEYS = 1 << 24
MOST_SHAPES = 256

# Rules with their verdicts, matched with all subdomains; the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Hosts that a list of unwanted sites names; they decide where no rule fits.
LISTED_HOSTS = ("casino-win.example.com/", "cheap-pills.example.com/", "free-bets.example.com/", "spam-farm.example.com/")


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Cascade:
    """The levels: (number of words, filter DataFrame of one row)."""

    def __init__(self, levels: list[tuple[int, DataFrame]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        # the first level that lacks the key decides; if the last one has it, its own kind of keys has it
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            words, held = self.levels[level - 1]
            verdict = F.when(bloom_holds(key, held, words, level), verdict).otherwise(F.lit(level % 2 == 0))
        return verdict


def build_cascade(listed: DataFrame, universe: DataFrame, most_keys: int = MOST_KEYS) -> Cascade:
    """A cascade that is exact for every key of the universe; both tables have one column, `key`.

    The unlisted keys are the universe less the listed ones; that set difference is taken once, here.
    """
    listed = cut(listed.select("key").filter(F.col("key").isNotNull()).distinct(), "cascade-listed")
    n = listed.count()
    if n > most_keys:
        raise ValueError(f"{n} listed keys exceed {most_keys}; filter them in parts")
    if not n:
        return Cascade([])
    inside, outside = listed, None
    levels: list[tuple[int, DataFrame]] = []
    while n:
        level, words = len(levels) + 1, bloom_words(n)
        held = cut(bloom_filter(inside, words, level), "cascade-filter")
        levels.append((words, held))
        if outside is None:
            passed = universe.select("key").filter(bloom_holds(F.col("key"), held, words, level)).distinct()
            # of the few that pass, those that are listed go
            both = passed.select("key", F.lit(False).alias("l")).unionAll(listed.select("key", F.lit(True).alias("l")))
            passed = both.groupBy("key").agg(F.bool_or("l").alias("l")).filter("not l").select("key")
        else:
            passed = outside.filter(bloom_holds(F.col("key"), held, words, level))
        passed = cut(passed, "cascade-passed")
        inside, outside, n = passed, inside, passed.count()
    return Cascade(levels)


def shapes_of(keys: DataFrame, most_shapes: int = MOST_SHAPES) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) of listed keys (`key`)."""
    at = F.position(F.lit("/"), F.col("key"))
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    rows = keys.filter(at > 0).select(labels.alias("labels"), (F.length("key") - at + 1).alias("size")).distinct().limit(most_shapes + 1).collect()
    if len(rows) > most_shapes:
        raise ValueError(f"listed keys have more than {most_shapes} shapes; filter them in parts")
    return sorted((r["labels"], r["size"]) for r in rows)


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape the key that a url could match, or null."""
    out = []
    for labels, size in shapes:
        fits = (host != "") & (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= size)
        out.append(F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size))))
    return out


def longest_listed(keys: list[str], *cascades: Cascade) -> Column:
    """The longest of the key columns that is in any of the cascades; null if none is."""
    found = []
    for key in keys:
        inside = F.lit(False)
        for c in cascades:
            inside = inside | c.contains(F.col(key))
        found.append(F.when(F.col(key).isNotNull() & inside, F.struct(F.length(key).alias("size"), F.col(key).alias("key"))))
    if not found:
        return F.lit(None).cast("string")
    return (found[0] if len(found) == 1 else F.greatest(*found))["key"]


def _table(spark: SparkSession, rows, *names: str) -> DataFrame:
    """Values as a table; a table stays one."""
    if isinstance(rows, DataFrame):
        return rows.select(*names)
    kind = "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>"
    values = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*values).cast(kind)))


def judge_urls(pages: DataFrame, page_id="page_id", url="url", rules=RULES, listed=LISTED_HOSTS, most_keys=MOST_KEYS, most_shapes=MOST_SHAPES) -> DataFrame:
    """One row per page row: page_id, host, path, rule (the longest that fits, or null), listed_key, verdict.

    rules: (rule, verdict) pairs or a table (rule, verdict); listed: hosts with a final '/' or a table (key).
    Without a rule, a url is blocked if its host is listed and allowed otherwise.
    """
    spark: SparkSession = pages.sparkSession
    rules = _table(spark, rules, "rule", "verdict").select(F.col("rule").alias("key"), "verdict")
    listed = _table(spark, listed if isinstance(listed, DataFrame) else [(k,) for k in listed], "key")
    shapes, hosts = shapes_of(rules, most_shapes), shapes_of(listed, most_shapes)
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    # listed hosts stand with '/', whatever the path
    rule_keys = {f"rule_{k}": c for k, c in enumerate(candidate_keys(F.col("host"), F.col("path"), shapes))}
    host_keys = {f"host_{k}": c for k, c in enumerate(candidate_keys(F.col("host"), F.lit("/"), hosts))}
    keyed = rows.select("*", *(c.alias(n) for n, c in {**rule_keys, **host_keys}.items()))
    every = F.array(*(F.col(n) for n in [*rule_keys, *host_keys])) if rule_keys or host_keys else F.array().cast("array<string>")
    universe = keyed.select(F.explode(F.array_compact(every)).alias("key")).distinct()
    universe = cut(universe, "cascade-universe")

    allow, block = (build_cascade(rules.filter(F.col("verdict") == verdict), universe, most_keys) for verdict in ("allow", "block"))
    sites = build_cascade(listed, universe, most_keys)
    found = keyed.select("page_id", "host", "path", longest_listed(list(rule_keys), allow, block).alias("rule"), longest_listed(list(host_keys), sites).alias("listed_key"))
    verdict = F.when(F.col("rule").isNotNull(), F.when(block.contains(F.col("rule")), "block").otherwise("allow")).when(F.col("listed_key").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", "listed_key", verdict.alias("verdict"))
