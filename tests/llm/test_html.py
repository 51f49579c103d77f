"""Main text by inferred wrappers."""

import html
import re

import pytest

from episodic.llm import html_extract as h

SF = "/root/testdata/sf0.001"
SHELL = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t='</p>';</script></head><body class=home><header><h1>Site</h1></header>"
         "<nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a><li>C</ul></nav><div class=\"ad big\">Buy</div><div id='cookie-notice'>We use cookies</div>{main}"
         "<aside>side</aside><div class='sidebar-left'>bar</div><form><label>Name</label><input value=x><button>Go</button></form>"
         "<section class='comments'><article class='comment'><p>nice post</p></article></section><footer><p>&copy; us</p></footer></body></html>")


def pages(spark, sources, host="http://x.example/"):
    rows = [(host + str(i), s, i, "t", 3) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "url string, html string, page_id long, text string, host int")


def texts(frame):
    return {r.page_id: r.text for r in h.extract(frame).collect()}


def test_chrome_is_left_out(spark):
    article = "<article><h1>Head &mdash; <i>line</i></h1><p>One  <b>bold</b>\n two&nbsp;three<p>Next<br>line<div class='content-with-sidebar'><ul><li>x<li>y</ul></div></article>"
    got = texts(pages(spark, [SHELL.format(main=article), SHELL.format(main="<main><p>Only <a href=q>linked</a> text.</p></main>"), SHELL.format(main="")]))
    assert got == {0: "Head — line One bold two three Next line x y", 1: "Only linked text.", 2: ""}


def test_pages_without_article(spark):
    body = "<div class='page'><div class='body'>" + "<p>A long paragraph of plain text, again and again.</p>" * 3 + "</div><div class='links'>" + "<a href=x>link here</a>" * 4 + "</div></div>"
    assert texts(pages(spark, [SHELL.format(main=body)]))[0] == " ".join(["A long paragraph of plain text, again and again."] * 3)


def test_all_of_an_article_without_article_tag(spark):
    """Titles, subheadings, lists, quotes, tables and short sections stay, however much of the text the paragraphs hold."""
    long = "<p>" + "A long paragraph of plain text. " * 40 + "</p>"
    body = ("<div class='post'><h1>Title</h1>" + long + "<h2><a href='#x'>Linked heading</a></h2>" + long + "<ul><li>first<li>second</ul><blockquote>Quote</blockquote>"
            "<table><tr><td>cell</td></tr></table><p><a href=x>See also</a></p></div><div class='more'><h2>Short</h2><p>section</p></div>"
            "<ul><li><a href=x>one link</a><li><a href=y>another</a></ul>")
    plain = " ".join(["A long paragraph of plain text."] * 40)
    want = f"Title {plain} Linked heading {plain} first second Quote cell See also Short section"
    assert texts(pages(spark, [SHELL.format(main=body), SHELL.format(main=body.replace("Title", "Other"))])) == {0: want, 1: want.replace("Title", "Other")}


@pytest.mark.parametrize(("source", "want"), [
    ("<p>a</p><svg class=i /><iframe src='x'/><object/><video controls/><canvas/><math/><p>b</p>", "a b"),
    ("<p>a <svg/> b</p><p>c</p><svg><title/><path/></svg><p>d</p>", "a b c d"),
    ("<div><button>Go</div><p>b</p><button>x</button><p>c</p>", "Go b c"),
    ("<form><select><option>o</form><p>b</p><select><option>o</select><p>c</p>", "o b c"),
    ("<div><iframe src=x></div><p>b</p><noscript>n</noscript><p>c</p>", "b c"),
    ("<p>a</p><svg><svg>i</svg>o</svg><object><p>x<object>y</object></object><p>b</p>", "a b"),
    ("<p>a</p><iframe src=http://x/>gone</iframe><p>b</p>", "a b"),
    ("<p>a</p><script src=x>var s='<svg/>';</script><p>b</p><textarea>t<p>c</p>", "a b"),
    ("<p>a</p>" + "<svg>" * 20_000 + "<button>" * 20_000 + "<p>b</p>", "a b")])
def test_elements_without_an_end_tag(source, want):
    assert " ".join(text for _, text, _ in h.parse(source).blocks) == want


def test_odd_rows(spark):
    sources = [None, "", "plain text only", "<p>unclosed <b>bold", "<article><p>cut off in a tag <a href='x", "<article><!-- no end <p>x", "a < b &amp c &unknown; &#233;", "<script>x",
               "<article>" + "<p>word</p>" * 20_000 + "</article>", "</div></p>text<article><p>&lt;p&gt;</p>"]
    frame = pages(spark, sources).union(spark.createDataFrame([(None, "<p>no url</p>", None, "t", 3), (None, "<p>no url</p>", None, "t", 3)], "url string, html string, page_id long, text string, host int"))
    got = h.extract(frame).collect()
    assert got and len(got) == len(sources) + 2 and h.extract(frame).columns == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r.text for r in got}
    assert by[0] == by[1] == by[7] == by[5] == "" and by[2] == "plain text only" and by[3] == "unclosed bold" and by[4] == "cut off in a tag"
    assert by[6] == "a < b & c &unknown; é" and by[8] == " ".join(["word"] * 20_000) and by[9] == "<p>"
    assert by[None] == "no url" and all(r.n_chars == len(r.text) for r in got)
    assert h.extract(frame.where("false")).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_given_pages(spark, sf):
    def plain(source):
        m = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
        parts = re.split(r"<(?:/?p|/?h1|br)>", m[1]) if m else []
        return " ".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts)))

    got = {r.page_id: r.text for r in h.op6_html(spark, sf).collect()}
    assert got == {r.page_id: plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


def test_wrapper_grows_by_alignment():
    w = h.Wrapper()
    one, _ = h.fold(["div", "#", "/div", "p", "#", "/p"])
    many, where = h.fold(["div", "#", "/div", "p", "#", "/p", "p", "#", "/p", "ul", "li", "#", "/li", "li", "#", "/li", "/ul"])
    assert many == ("div", "#", "/div", ("+", ("p", "#", "/p")), "ul", ("+", ("li", "#", "/li")), "/ul") and where[4] == where[7] == 1 and where[11] == where[14] == 2
    assert w.add(one) == [0, 1]
    assert w.add(many)[:2] == [0, 1]  # the repeated group takes the place of what stood once
    assert w.add(h.fold(["p", "#", "/p"])[0]) == [1]  # the div is optional now
    assert [n.group for n in w.nodes] == ["", "", "", "+", "?", "?", "?"] or any(n.group == "?" for n in w.nodes)


def test_nested_repeats():
    stream, where = h.fold(["tr", "td", "#", "/td", "td", "#", "/td", "/tr"] * 3)
    assert stream == (("+", ("tr", ("+", ("td", "#", "/td")), "/tr")),) and {w for w in where if w >= 0} == {0}
