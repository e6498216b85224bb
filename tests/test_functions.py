from pyspark.sql import functions as F
import pytest

from graniteseek.functions.text import clipped_label, collapsed, engine_list, first_nonempty, heading_of, retrieval_tokens, truncated, windows, xml_attribute, xml_text
from graniteseek.functions.urls import canonical_url, is_document, is_http, normal_host, path_suffix, resolved, url_domain
from graniteseek.functions.vectors import cosine, hash_vectors
from graniteseek.operators.urls import all_public, blocked_list, drop_blocked, safety_code


def values(spark, rows, *columns):
    """Evaluates expressions over string rows x."""
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [tuple(r)[1:] for r in frame.select("k", *columns).orderBy("k").collect()]


def one(spark, rows, column):
    return [r[0] for r in values(spark, rows, column)]


X = F.col("x")


def test_tokens_split_at_accents_and_keep_punctuation(spark):
    assert one(spark, ["Öl yeast. C++ a_b/c", None, ""], retrieval_tokens(X)) == [["l", "yeast.", "c", "a_b/c"], [], []]


def test_headings(spark):
    assert one(spark, ["# A", "###### B c ", "####### no", "#no", "text", "## a\nb"], heading_of(X)) == ["A", "B c", None, None, None, "a\nb"]


@pytest.mark.parametrize(("n", "want"), [(0, "abcdef"), (-1, "abcdef"), (None, "abcdef"), (3, "abc"), (9, "abcdef")])
def test_truncation(spark, n, want):
    assert one(spark, ["abcdef"], truncated(X, n)) == [want]


def test_labels(spark):
    long = "word " * 60
    got = one(spark, ["short", long.strip(), "x" * 200], clipped_label(collapsed(X)))
    assert got[0] == "short" and got[1].endswith("word…") and len(got[1]) <= 161 and got[2] == "x" * 160 + "…"


def test_windows_step_and_fallback(spark):
    got = one(spark, ["abcdefgh", ""], windows(X, 4, 1))
    assert [(w.start, w.text) for w in got[0]] == [(0, "abcd"), (3, "defg"), (6, "gh")] and got[1] == []
    assert [w.start for w in one(spark, ["abcdefgh"], windows(X, 4, 4))[0]] == [0, 4]


def test_xml(spark):
    assert one(spark, ["a<b>&\x00c</x>"], xml_text(X)) == ["a&lt;b&gt;&amp;c&lt;/x&gt;"]
    assert one(spark, ['say "hi"', "it's", "both \"'"], xml_attribute(X)) == ["'say \"hi\"'", '"it\'s"', '"both &quot;\'"']


def test_small_text_functions(spark):
    assert one(spark, ["bing, ,google ,", ""], engine_list(X)) == ["bing,google", ""]
    assert one(spark, [" ", "d"], first_nonempty(F.lit(None).cast("string"), X, F.lit("z"))) == ["z", "d"]


def test_hosts(spark):
    rows = ["HTTPS://WWW.Example.com:8080/a", "example.org.", "a b.com", None, "http://u@host.net/x", "www.x.com/path"]
    assert one(spark, rows, normal_host(X)) == ["example.com", "example.org", "", "", "host.net", "x.com"]
    assert one(spark, ["https://www.a.com/", "nothing"], url_domain(X)) == ["a.com", ""]


def test_canonical(spark):
    rows = ["HTTP://A.com", "https://a.com/P?q=1#f", "ftp://a.com/", "https:///x", None, "https://a.com?x"]
    assert one(spark, rows, canonical_url(X)) == ["http://a.com/", "https://a.com/P?q=1", None, None, None, "https://a.com/?x"]
    assert one(spark, ["https://a.com/x.PDF?y", "https://a.com/d.docx", "https://a.pdf/"], path_suffix(X)) == ["pdf", "docx", ""]
    assert one(spark, ["https://a.com/x.doc", "https://a.com/x.html"], is_document(X)) == [True, False]
    assert one(spark, ["HtTp://x", "mailto:x", None], is_http(X)) == [True, False, False]


@pytest.mark.parametrize("href", ["/a", "b", "../b", "./c/../d", "../../../e", "//h.org/x", "?q=1", "https://z.org/", "/a/./b/..", "g?y/../x", ""])
def test_resolution_agrees_with_the_standard_library(spark, href):
    from urllib.parse import urljoin

    if href:
        base = "https://h.com/one/two/three?x=1#f"
        assert one(spark, [href], resolved(F.lit(base), X)) == [urljoin(base, href)]


def test_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in frame.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_hash_vectors_have_length_one(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "k int, tokens array<string>")
    rows = hash_vectors(frame, ["k"]).collect()
    assert len(rows) == 1 and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-12


def test_safety_codes(spark):
    rows = ["https://example.com/", "ftp://x", "https://u:p@h.com", "http://", None, "http://127.0.0.1/", "http://[::1]/", "http://10.0.0.1", "http://8.8.8.8", "http://169.254.1.1", "http://224.0.0.1", "http://0.0.0.0", "http://localhost/", "http://[2001:4860:4860::8888]/", "http://[::ffff:10.0.0.1]/"]
    want = ["ok", "invalid_url", "invalid_url", "invalid_url", "invalid_url", "blocked_url", "blocked_url", "blocked_url", "ok", "blocked_url", "blocked_url", "blocked_url", "blocked_url", "ok", "blocked_url"]
    assert one(spark, rows, safety_code(X)) == want


def test_any_private_answer_rejects(spark):
    frame = spark.createDataFrame([("a", "8.8.8.8"), ("a", "10.0.0.1"), ("b", "8.8.4.4")], "host string, address string")
    assert {r.host: r.public for r in all_public(frame).collect()} == {"a": False, "b": True}


def test_blocked_domains(spark):
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(["https://bad.com/", "https://www.bad.com/x", "https://a.b.bad.com", "https://notbad.com", "https://bad.com.org/", "https://evil.net/"])], "k int, url string")
    kept = drop_blocked(frame, blocked_list(spark, ["BAD.com", "https://www.evil.net/p", ""]))
    assert sorted(r.k for r in kept.collect()) == [3, 4]
    assert drop_blocked(frame, blocked_list(spark, [])).count() == 6
