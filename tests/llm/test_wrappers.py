import html
import json
import random
import re
import time

import pytest

from loanlens.llm import wrappers


def texts(spark, pages):
    frame = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in pages], "page_id long, url string, html string, text string, host string")
    out = wrappers.extract_text(frame)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return sorted(((r.page_id, r.text) for r in rows), key=str)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in wrappers.extract_text(pages).collect()}
    for i, source in rows.items():  # the article, by hand
        body = source[source.find("<article>") + 9 :].split("</article>")[0]
        assert got[i] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def page(body, before="", after=""):
    return f"<html><head><title>t</title><style>x</style></head><body>{before}<div class='post'>{body}</div>{after}</body></html>"


def test_template_without_marked_parts(spark):
    """No tag tells the template from the text here, only that it is the same on every page."""
    pages = [(i, f"http://h.net/{i}", page("".join(f"<p>story {i} part {k}</p>" for k in range(1 + i % 4)), "<div>Welcome to us</div>",
                                           "<div>All rights with us</div>")) for i in range(40)]
    got = texts(spark, pages)
    assert got == sorted(((i, " ".join(f"story {i} part {k}" for k in range(1 + i % 4))) for i, _, _ in pages), key=str)


@pytest.mark.parametrize("n", [9, 10])
def test_a_marked_article_keeps_what_other_pages_have_too(spark, n):
    pages = [(i, f"http://h.net/{i}", f"<body><div>menu of all</div><article><h1>Summary</h1><p>story {i}</p></article></body>") for i in range(n)]
    assert texts(spark, pages) == sorted(((i, f"Summary story {i}") for i in range(n)), key=str)


def test_pages_with_very_many_kinds_of_tags(spark):
    source = "<body>" + "".join(f"<x{k}.c>w{k}</x{k}.c>" for k in range(80_000)) + "</body>"
    want = " ".join(f"w{k}" for k in range(80_000))
    assert texts(spark, [(1, "http://a.net/", source), (2, "http://a.net/", source)]) == [(1, want), (2, want)]


def test_closing_tags_that_fit_nothing():
    start = time.perf_counter()
    page = wrappers.Page("<b>" * 16_000 + "</i>" * 16_000 + "x")
    assert time.perf_counter() - start < 1 and page.texts == [("x", 0, False)]
    nested = wrappers.Page("<article><div class=ad><p>a</span></div>b</article>c")
    assert [t[1:] for t in nested.texts] == [(2, True), (0, True), (0, False)]


def test_side_parts(spark):
    side = ("<nav>n</nav><header>h</header><div id='cookie-notice'>c</div><aside>s</aside><form>f<input value=1></form><script>if(a<b){}</script>"
            "<div class=\"reader comments\">r</div><p style='display: none'>x</p><footer>e</footer><!-- no --><noscript>j</noscript>")
    got = texts(spark, [(1, "http://a.net/", page(f"<article>{side}<header>by me <h1>Head &amp; line</h1></header>\n<p>one\n two<b>th</b>ree</p><p>4&nbsp;&lt;5{side}</article>", side, side))])
    assert got == [(1, "Head & line one twothree 4 <5")]


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<article>a<div class=ad>b<article>c", "a c"),
    ("x <", "x <"), ("<p>a &am", "a &am"), ("<p title='a>b'>c</p>", "c"), ("<p title=\"unclosed>c</p>", "c"), ("<!-- open", ""),
    ("<script>open", ""), ("<article>" + "<p>w</p>" * 5000 + "</article>", " ".join(["w"] * 5000)), ("<foo(bar+#>x</foo>", "x"),
])
def test_odd_pages(spark, source, want):
    assert texts(spark, [(None, None, source), (1, None, source), (1, None, source)]) == [(1, want), (1, want), (None, want)]


def test_no_pages(spark):
    assert texts(spark, []) == []


def items(source):
    names, p = wrappers.Names(), wrappers.Page(source)
    form, counts = p.form(names)
    assert sum(counts) == len(p.texts) and len(counts) == len(form)
    return wrappers.page_items(p, form, counts, names)


def test_alignment():
    a, b = items("<ul><li>1</li><li>2</li><li>3</li></ul><p>same</p><i>x</i>"), items("<ul><li>1</li><li>2</li></ul><p>same</p><u>y</u><i>z</i>")
    out = wrappers.align(a, b)
    assert [i[0] for i in out] == ["<ul", "+(<li#>li)", ">ul", "<p", "#", ">p", "<u", "#", ">u", "<i", "#", ">i"]
    assert out[4][1] is not None and out[10][1] is None  # a text that stays and a slot
    assert [i[2] for i in out] == [False] * 6 + [True] * 3 + [False] * 3
    single = wrappers.align(out, items("<ul><li>1</li></ul><p>same</p><i>x</i>"))  # one item is covered by the group
    assert [i[0] for i in single] == [i[0] for i in out]


def test_order_of_pages_is_free(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP_PAGES", 2)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(9)
    found = wrappers.infer_wrappers(pages).collect()
    assert len(found) == len({r.host for r in found}) and sum(r.n_pages for r in found) == pages.count()
    assert all(json.loads(r.wrapper) for r in found)


def test_matching_blocks():
    rng = random.Random(6)
    for n in range(300):
        a = [rng.choice("abcdefgh") if n % 2 else f"t{rng.randrange(60)}" for _ in range(rng.randint(0, 40))]
        b = [t for t in a if rng.random() < 0.8] + [rng.choice("abxyz")] * rng.randint(0, 3)
        found = wrappers.matching(a, b)
        at = (0, 0)
        for i, j, size in found:
            assert i >= at[0] and j >= at[1] and size > 0 and a[i : i + size] == b[j : j + size]
            at = (i + size, j + size)
        assert at <= (len(a), len(b))
        assert wrappers.matching(a, a) == ([(0, 0, len(a))] if a else [])


def test_long_varied_pages_align_in_bounded_time():
    a = [t for k in range(60_000) for t in ("<li", "#", ">li", f"<x{k}")]
    b = [t for t in a if not t.startswith("<x7")]
    start = time.perf_counter()
    assert sum(n for _, _, n in wrappers.matching(a, b)) >= 0.9 * len(b)
    assert time.perf_counter() - start < 20
