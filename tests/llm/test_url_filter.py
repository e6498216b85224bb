import random
import re

from pyspark.sql import functions as F
import pytest

from graniteseek.llm.url_filter import LISTED_HOSTS, RULES, build_cascade, judge_urls


def brute(url):
    _, mark, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if mark else ""
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0] if mark else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    listed = any(host == h.rstrip("/") or host.endswith("." + h.rstrip("/")) for h in LISTED_HOSTS)
    return host, path, None, "block" if listed else "allow"


def test_matches_brute_force(spark):
    rng = random.Random(8)
    urls = [None, "", "no scheme", "http://", "https://net", "https://NET/", "x://a.net?q=/", "https://a.net/?u=http://b.org/fr/", "http://user@a.net/x", "http://a.net:80/", "http://xnet/", "https://spam-farm.example.com", "a\nb://sub.casino-win.example.com#x", "https://example.net/en", "https://É.net/é", "http://.net/", "//a.net/"]
    for _ in range(400):
        host = ".".join(rng.choices(["a", "www", "example", "Example", "x-y"], k=rng.randint(0, 3)) + [rng.choice(["net", "org", "com", "example.net", "example.com", "free-bets.example.com"])])
        urls.append(f"http{rng.choice(['', 's'])}://{host}{rng.choice(['', '/', '/en/', '/de/x', '/fr/', '/en', '/EN/', '/fr/a?b', '#f', '?q'])}")
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("extra")).withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame).collect()}
    assert {k: brute(u) for k, u in enumerate(urls)} == got


def test_long_urls_repeats_and_empty_inputs(spark):
    frame = spark.createDataFrame([(1, "http://a.net/" + "x/" * 100000), (1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(frame).collect()] == ["block"] * 3
    assert judge_urls(frame.limit(0)).count() == 0
    assert {r.verdict for r in judge_urls(frame, rules=(), listed=()).collect()} == {"allow"}


@pytest.mark.parametrize("n", [0, 1, 700])
def test_the_cascade_is_exact_over_its_universe(spark, n):
    universe = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.filter(F.xxhash64("key") % 7 == 0).orderBy("key").limit(n)
    cascade = build_cascade(listed, universe)
    assert n < 700 or len(cascade.levels) > 1
    found = universe.filter(cascade.contains(F.col("key")))
    assert sorted(r.key for r in found.collect()) == sorted(r.key for r in listed.collect())


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = judge_urls(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Join" not in plan


def test_lists_as_tables(spark):
    rng = random.Random(3)
    hosts = [f"h{k}.example.org" for k in range(2000)]
    listed = spark.createDataFrame([(h + "/",) for h in hosts[::2]] * 2, "key string")
    rules = spark.createDataFrame([("h4.example.org/a", "allow"), ("h5.example.org/a", "block"), ("h5.example.org/ab", "allow")], "rule string, verdict string")
    urls = [f"https://{rng.choice(['', 'www.'])}{h}/{rng.choice(['a', 'ab', 'b'])}" for h in hosts]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, listed=listed).collect()}
    for k, u in enumerate(urls):
        want = (None, "allow" if k % 2 else "block")
        if k == 4 and "/a" in u:
            want = ("h4.example.org/a", "allow")
        if k == 5 and "/a" in u:
            want = ("h5.example.org/ab", "allow") if u.endswith("/ab") else ("h5.example.org/a", "block")
        assert got[k] == want
    with pytest.raises(ValueError, match="shapes"):
        judge_urls(spark.createDataFrame([(1, "x")], "page_id long, url string"), rules=rules, listed=listed, most_shapes=1)


def test_equal_rules_and_ties(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (2, "http://b.net/x")], "page_id long, url string")
    rows = judge_urls(frame, rules=(("net/", "allow"), ("a.net/", "block"), ("a.net/", "block")), listed=()).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in rows) == [(1, "a.net/", "block"), (1, "a.net/", "block"), (2, "net/", "allow")]
