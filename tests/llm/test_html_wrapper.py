import json
import random

import pytest
from pyspark.sql import functions as F

from graniteseek.llm.html_wrapper import Level, aligned, expression, extract_main_text, infer_wrappers, matched, read


def expr(page):
    return expression(read(page).items)


@pytest.mark.parametrize(("page", "want"), [
    ("<ul><li>a<li>b</ul>", "ul(li+(#))"),
    ("<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p>", "(h2(#) p+(#))+"),
    ("<h2>a</h2><p>b</p><h2>c</h2><h2>d</h2><p>e</p><footer>x</footer>", "(h2+(#) p(#))+ footer(#)"),
    ("<p><b>x<br><p>y</p>", "p+(b?(# br) #?)"),
    ("", ""), ("text", "#"), ("<div>", "div"), ("</p>x", "#"), ("<p>a<", "p(#)")])
def test_pages_fold(page, want):
    assert expr(page) == want


def test_alignment_finds_options_and_repeats():
    a, b, c = (read(p).items for p in ("<h1>t</h1><p>x</p>", "<h1>t</h1><div>ad</div><p>x</p><p>y</p>", "<p>x</p>"))
    wrapper = aligned(aligned(a, b), c)
    assert expression(wrapper) == "h1?(#) div?(#) p+(#)"
    assert aligned(wrapper, a) == wrapper and aligned(wrapper, b) == wrapper


ARTICLE = ["Über <b>uns</b> &amp; more", "second\n  block&nbsp;here &lt;tag&gt;", "<a href='/x'>linked</a> text", "one<br>two"]
TEXT = "Title\n\nÜber uns & more\n\nsecond block here <tag>\n\nlinked text\n\none two"


def page(body, closed=True):
    return ("<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>"
            f"<!-- note --><div class='ad banner'>Buy</div>{body}<aside>side</aside><form><p>Form</p></form><div id=cookie-notice>Cookies</div><section class=comments><p>Reader: hi</p></section><footer>&copy; x</footer>" + ("</body></html>" if closed else ""))


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>"])
def test_main_text(spark, frame):
    body = "<h1>Title</h1>" + "".join(f"<p>{x}" for x in ARTICLE)
    other = "<h1>Other</h1><p>just one</p><ul><li>a</li><li>b</li></ul>"
    rows = [(1, "http://h.com/1", page(frame.format(body))), (2, "http://H.com/2", page(frame.format(other), closed=False)), (3, None, page(frame.format(body))), (1, "http://h.com/1", page(frame.format(body)))]
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("extra"))
    got = [(r.page_id, r.text, r.n_chars) for r in extract_main_text(frame_).collect()]
    assert sorted(got) == sorted([(1, TEXT, len(TEXT)), (2, "Other\n\njust one\n\na\n\nb", 21), (3, TEXT, len(TEXT)), (1, TEXT, len(TEXT))])
    assert [r.text for r in extract_main_text(frame_, broadcast_bytes=-1).orderBy("page_id").collect()][0] == TEXT


def test_odd_pages(spark):
    deep = "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>"
    rows = [(1, "x", None), (2, "x", ""), (3, "x", deep), (4, "x", "<article>" + "<p>word " * 20000), (5, "y", "<article>a <b c=\"d>e\">f</b> g &am &#233;</article>"), (6, "y", "plain < text")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1], got[2], got[3], got[5]) == ("", "", "deep", "a f g &am é") and got[4] == "\n\n".join(["word"] * 20000) and got[6] == "plain < text"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_main_text(empty).count() == 0 and infer_wrappers(empty).count() == 0


def test_one_wrapper_for_each_host(spark):
    rng = random.Random(2)
    rows = [(k, f"https://h{k % 2}.org/{k}", page("<article><h1>t</h1>" + "<p>x</p>" * rng.randint(1, 5) + rng.choice(["", "<ul><li>l</ul>"]) + "</article>")) for k in range(40)]
    got = infer_wrappers(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).orderBy("host").collect()
    assert [(r.host, r.n_pages) for r in got] == [("h0.org", 20), ("h1.org", 20)]
    assert all("article(h1(#) p+(#) ul?(li(#)))" in r.wrapper for r in got)


def test_slots_are_places_of_the_wrapper(spark):
    lists = [f"<title>t{k}</title><body><h2>a{k}</h2><p>b{k}</p><h2>c{k}</h2><p>d{k}</p></body>" for k in range(3)]
    bare = [f"<title>u{k}</title><body><p>Nothing here yet</p><div>n{k}</div></body>" for k in range(3)]  # a paragraph outside the group
    frame = spark.createDataFrame([(k, f"http://h.com/{k}", x) for k, x in enumerate(lists + bare)], "page_id long, url string, html string")
    assert "(h2(#) p(#))*" in infer_wrappers(frame).first().wrapper
    got = {r.page_id: r.text for r in extract_main_text(frame).collect()}
    assert got == {k: f"a{k}\n\nb{k}\n\nc{k}\n\nd{k}" for k in range(3)} | {k: f"n{k - 3}" for k in range(3, 6)}


def test_a_host_of_copies_keeps_its_text(spark):
    page_ = "<title>t{}</title><body><div><p>All of this</p><p>is said once</p></div></body>"
    rows = [(k, "http://copies.com/", page_.format("")) for k in range(4)] + [(k, f"http://mirrors.com/{k}", page_.format(k)) for k in range(4, 8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.text for r in extract_main_text(frame).collect()} == {"All of this\n\nis said once"}


def test_many_streams_of_a_host_are_aligned_as_a_tree(spark):
    rng = random.Random(5)
    tags = ["h2", "p", "ul", "blockquote", "pre", "table"]
    rows = [(k, f"http://big.com/{k}", "<body>" + "".join(f"<{t}>text {k}</{t}>" for t in rng.sample(tags, rng.randint(1, 6))) + "</body>") for k in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, other = (infer_wrappers(f, streams=8).first() for f in (frame, frame.repartition(7)))
    assert (one.wrapper, one.n_pages) == (other.wrapper, other.n_pages) and one.n_pages == 300
    wrapper = Level(json.loads(one["items"]))
    for _, _, page_ in rows:  # a brute-force match: every element and text of the page has its place
        assert all("-1" not in slot for *_, slot, _ in matched(page_, wrapper) if slot)


def test_the_alignment_decides_the_text(spark):
    # the same slot by name, inside and outside the repeated group that alignment finds
    rows = [(k, f"http://h.com/{k}", f"<body><p>Same notice on every page</p><div>x{k}</div></body>") for k in range(4)]
    rows += [(k, f"http://h.com/{k}", f"<body><h2>a{k}</h2><p>Same notice on every page</p><h2>b{k}</h2><p>c{k}</p></body>") for k in range(4, 8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(frame).collect()}
    assert all(got[k] == f"x{k}" for k in range(4)) and all("Same notice" in got[k] for k in range(4, 8))


def test_of_several_matches_the_earliest_places_count():
    level = Level([["p", 0, 1, []], ["div", 0, 1, []], ["()", 0, 2, [["h2", 1, 1, []], ["p", 0, 1, []]]]])
    assert level.match(["p"]) == [0] and level.match(["div", "h2", "p"]) == [1, 2, 3] and level.match(["h2", "p", "h2", "p"]) == [2, 3, 2, 3]
    assert level.match(["p", "table", "p"])[1] == -1


def naive_events(page):
    """What `events` says, by walking the whole stack for every tag."""
    from graniteseek.llm import html_wrapper as h

    stack, out, at = [], [], 0

    def pop_to(depth):
        while len(stack) > depth:
            out.append(("close", stack.pop()))

    for m in h._TOKEN.finditer(page):
        if m[4] or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] == tag:
                    pop_to(depth)
                    break
            continue
        if tag in h.ENDS_PARAGRAPH or tag in h.ENDED_BY:
            ends = h.ENDED_BY.get(tag) or {"p"}
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in ends:
                    pop_to(depth)
                    if tag != "tr":
                        break
                elif stack[depth] in h.LISTS or stack[depth] not in h.INLINE and stack[depth] != "p":
                    break
        if tag in h.VOID:
            continue
        stack.append(tag)
        out.append(("open", tag))
    pop_to(0)
    return out


def test_nesting_equals_a_walk_of_the_whole_stack():
    import random

    from graniteseek.llm.html_wrapper import events

    rng = random.Random(4)
    names = "div p b i ul li table tr td th dl dt dd span hr section a h1 br select option".split()
    for _ in range(300):
        page = "".join(f"<{'/' if rng.random() < 0.35 else ''}{rng.choice(names)}>" for _ in range(rng.randint(0, 60)))
        assert [(k, t) for k, _, t in events(page) if k in ("open", "close")] == naive_events(page)


def test_stray_ends_and_deep_nesting_take_linear_time():
    import time

    from graniteseek.llm.html_wrapper import events

    for page in ("<div>" * 90_000 + "</q>" * 140_000, "<p><b>" + "<i>" * 150_000 + "<hr>" * 130_000, "<b>" * 170_000 + "</p>" * 120_000):
        began = time.time()
        assert len(page) > 900_000 and sum(1 for _ in events(page)) > 100_000
        assert time.time() - began < 5
