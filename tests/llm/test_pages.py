import time

from assay.llm import pages
from assay.params import Skew

SCHEMA = "page_id long, url string, html string, text string, host int"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content-%d"><div class="post post-%d"><h2>Fish &amp; chips</h2><p>One&nbsp;two  <i>three</i><br>four<p>Five &lt;six&gt;
seven<ul><li>eight<li>nine</ul><aside>aside</aside><script>if (a<b) {"</div>"}</script><form>f<input></form>
<div class="comments"><p>A reader says a lot, a whole lot, more than the author ever did say in all of the article above.</div>
</div></div><div class="sidebar">side</div><footer>&copy; 2024</footer></body></html>"""
TEXT = "Fish & chips\nOne two three four\nFive <six> seven\neight\nnine"


def test_the_article_alone(spark):
    rows = [(i, f"https://x.example/{i}", PAGE % (i, i * 7), "own", 1) for i in range(5)]
    # A short post, which by itself would be outscored by what stands around it.
    odd = '<html><body class="page"><div id="content-3"><div class="post post-9"><p>Hi.</div></div><div class="links-x"><p>%s</div>' % ("word " * 30)
    rows.append((9, "https://X.example/9", odd, "own", 1))
    out = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["text"] == TEXT and out[i]["n_chars"] == len(TEXT) for i in range(5))
    assert out[9]["text"] == "Hi."


def test_votes_count_paths_without_numbers(spark):
    rows = [(i, "http://h.example:80/p", PAGE % (i, i), None, None) for i in range(3)]
    votes = pages.votes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(v) for v in votes] == [("h.example", "/html/body.page/div.content-#/div.post.post-#", 3)]


def test_odd_pages(spark):
    rows = [
        (1, None, None, None, None),
        (1, None, "", None, None),
        (2, "not a url", "plain <b>text", None, None),
        (3, "http://a.example", "<article><p>cut off in a t", None, None),
        (4, "http://b.example", "<p>x</p>" * 20_000, None, None),
        (5, "http://c.example", "<div>" * 3000 + "deep" + "</div>" * 10, None, None),
        (6, "http://d.example", "<article>a<br>b <!-- c <p> --> d &amp;amp; <a href='<x>'>e</a></article><p", None, None),
        (None, "http://e.example", "</p></div></html><script>x", None, None),
        (7, "http://f.example", "<html><head><title>t<body class=x><p>kept<p>too", None, None),
        (8, "http://g.example", '<p>one <a href="x>two</a> three</p>', None, None),
    ]
    out = sorted(((r["page_id"], r["text"]) for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    found = dict(out)
    assert len(out) == 10 and found[1] == "" and found[None] == ""
    assert found[2] == "plain text" and found[3] == "cut off in a t" and found[4] == "\n".join("x" * 20_000)
    assert found[5] == "deep" and found[6] == "a b d &amp; e"
    assert found[7] == "kept\ntoo" and found[8] == "one two three"
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_article_of_a_rarer_template(spark):
    usual = "<html><body><div class='post'><p>%s</p></div></body></html>" % ("A story of the usual kind. " * 5)
    rare = "<html><body><main><h1>Rare</h1><p>%s</p></main><div class='post'><p>Teaser of another story.</p></div></body></html>" % ("Long text. " * 20)
    rows = [(i, f"https://t.example/{i}", usual, None, None) for i in range(9)] + [(9, "https://t.example/9", rare, None, None)]
    out = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[9] == "Rare\n" + ("Long text. " * 20).strip()
    assert out[0] == ("A story of the usual kind. " * 5).strip()
    # A winning path inside the page's own article is the more exact one.
    inner = "<body><article><div class='post'><p>Kept text of it.</p></div><p>by</p></article></body>"
    assert pages.text_at(pages.read(inner), ["/body/article/div.post"]) == "Kept text of it."


def test_names_inside_articles_count_whole():
    html = """<article><h2 id='social-history'>Social history</h2><section id='related-work'><h3>Related work</h3><p>Much.</p></section>
    <p class='related-work'>More.</p><div class='cookie-notice'>c</div><div class='ad-slot'>a</div><div class='comment-list'>r</div>
    <div class='share'>s</div><div id='newsletter-signup'>n</div><p class='price share-price'>Up.</p></article>"""
    assert pages.text_at(pages.read(html), []) == "Social history\nRelated work\nMuch.\nMore.\nUp."
    assert pages.text_at(pages.read("<div><p class='ad-hoc'>x</p><p>y</p></div>"), []) == "y"


def test_long_and_deep_pages_take_linear_time():
    odd = [
        "<a " * 100_000,
        "x><p>" + "<a " * 100_000,
        "<div class='abc'>" * 100_000 + "deep",
        "<p><span>" * 100_000 + "t" + "</b>" * 100_000,
        '<a ">" ' * 100_000,
        "<!-- " * 100_000,
        "<script " * 100_000 + ">",
        "<li>x" * 100_000,
    ]
    for html in odd:
        start = time.process_time()
        page = pages.read(html)
        pages.best_path(page)
        text = pages.text_at(page, ["/div.abc/div.abc", "/body"])
        assert time.process_time() - start < 5, html[:20]
        assert text in ("", "x>", "deep", "t", "\n".join("x" * 100_000)) or '">"' in html
    assert pages.text_at(pages.read("<p>a</p><!-- b > c"), []) == "a"


def test_winning_paths_by_broadcast_and_by_host(spark):
    rows = [(i, f"http://h{i % 7 if i % 3 else 0}.example/", PAGE % (i, i) if i % 11 else None, None, None) for i in range(60)]
    given = spark.createDataFrame(rows + [(60, None, None, None, None), (61, "http://empty.example", "", None, None)], SCHEMA)
    won = pages.winners(pages.votes(given))
    hosts = given.select("page_id", pages.host("url").alias("host"), "html")
    near, far = (
        sorted(pages.with_paths(hosts, won, most=most, skew=Skew(hot_rows=5, salts=3)).select("page_id", "paths").collect(), key=str)
        for most in (100, 0)
    )
    assert near == far and len(far) == 62 and sum(r["paths"] is None for r in far) == 2
