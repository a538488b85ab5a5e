"""The stack reader of pages."""

import html
import re

import pytest

from strataforge.operators import pages as P


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("<p><b>x</b> y</p>", [("p", "x y")]),
        ("<p>a<p>b<div>c</div><h2>d", [("p", "a"), ("p", "b"), ("h2", "d")]),
        ("<ul><li><p>one</p><p> two</p><li>three<ul><li>inner</ul> after</ul>", [("li", "one two"), ("li", "three after"), ("li", "inner")]),
        ("<p>a<br>b &amp; c&nbsp;d</p>", [("p", "a b & c d")]),
        ("<nav><p>no</p></nav><script>'<p>no</p>'</script><p>yes</p><footer><p>no", [("p", "yes")]),
        ("<div class='Related links'><p>no</p></div><div class='shared-body'><p>yes</p></div>", [("p", "yes")]),
        ("<p>un<em>closed <i>tags</p> x </b><p>next</p>", [("p", "unclosed tags"), ("p", "next")]),
        ("<h1><span>big</span> <a href=x>title</a></h1><p></p><p> </p>", [("h1", "big title")]),
        ("<table><tr><td><p>cell</table><p>out", [("p", "cell"), ("p", "out")]),
        ("<p>a<!-- <p>no</p> -->b</p><hr/><img src=x><p/>c", [("p", "ab"), ("p", "c")]),
        ("", []),
    ],
)
def test_lines(body, wanted):
    assert P.lines_of(page(body)) == wanted


def test_main_node_has_text():
    long = "word " * 60
    assert P.lines_of(page(f"<main></main><article><p>{long}</p></article><p>outside</p>")) == [("p", long.strip())]
    assert P.lines_of(page(f"<article><p>short</p></article><p>{long}</p>")) == [("p", "short"), ("p", long.strip())]
    assert P.lines_of(page(f"<p>{long}</p><div id='topic-summary'><p>{long}2</p></div><main><p>{long}</p></main>")) == [("p", f"{long}2")]
    assert P.lines_of(page(f"<div class='x main-content'><h3>in</h3><p>{long}</p></div><p>out</p>")) == [("h3", "in"), ("p", long.strip())]
    assert P.lines_of(None) == P.lines_of("") == [] and P.lines_of("<p>no page at all") == [("p", "no page at all")]


def test_given_pages_keep_their_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    lines = P.page_lines(pages)
    assert lines.columns == ["page_id", "pos", "tag", "line", "size"]
    kept = {r["page_id"]: r["n"] for r in lines.selectExpr("page_id", "length(regexp_replace(line, '\\\\s', '')) as l").groupBy("page_id").sum("l").withColumnRenamed("sum(l)", "n").collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        text = "".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert kept[r["page_id"]] >= 0.97 * len(text)
