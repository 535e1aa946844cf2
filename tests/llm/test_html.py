"""HTML extraction against a plain reading of the pages' articles, on broken markup, and for what sites repeat."""

import html as entities
import re
import time

import pytest

from sentinelle.llm import html
from sentinelle.llm.q_html import op13_html_text

SF = "/root/testdata/sf0.001"


def text(source):
    return html.without(html.parsed(source), set())


def brute(source):
    """The pages of the tables have one article of headings and paragraphs; some are cut off."""
    article = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    blocks = [" ".join(entities.unescape(x.replace("<b>", "").replace("<br>", " ")).split()) for x in re.split(r"</?p>|</?h1>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_all_pages(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op13_html_text(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(rows)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, brute(rows[r.page_id].html), len(r.text))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain  text\n&amp; more", "plain text & more"),
        ("<p>a<p>b<br>c<b>d</b>", "a\n\nb cd"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<header><h1>Site</h1></header><nav>menu</nav><main><h1>T</h1><p>x</p></main><aside>s</aside><footer>f</footer>", "T\n\nx"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>f</footer></article><article><p>y</p></article>", "T\n\nx\n\ny"),
        ('<div class="cookie-notice">c</div><div id="content"><p>x</p><div class="ad">buy</div><form><p>mail</p></form></div><section id="comments"><article><p>no</p></article></section>', "x"),
        ('<form id="page"><article><p>x</p></article></form>', "x"),
        ('<div class="layout has-sidebar"><p>x</p></div><div class="sidebar left">y</div>', "x"),
        ('<article><p>x</p><div class="comments"><p>no</p></div><div role="complementary">no</div></article>', "x"),
        ("<p>a<script>var t='</p>'; if (a<b) {}</script>b<style>p{}</style><!-- c > <p> -->d</p>", "abd"),
        ("<p title='a > b'>x</p><p data-x=\"<p>\">y", "x\n\ny"),
        ("<p>x</p><!-- never ends <p>y", "x"),
        ("<p>x</p><script>never ends <p>y", "x"),
        ("<p>1 < 2 &lt;3&#62; &nbsp; &unknown; &am", "1 < 2 <3> &unknown; &am"),
        ("<div>a<p>b</p>c</div></div></p>d", "a\n\nb\n\nc\n\nd"),
        ("<P>A</P><SCRIPT>x</ScRiPt ><P CLASS=AD>no</P>İ<p>B", "A\n\nİ\n\nB"),
        ("<article>", ""),
    ],
)
def test_markup(source, want):
    assert text(source) == want


def test_time_grows_with_the_length():
    began = time.time()
    for source in ("<a \"<a '<p class=\"x", "<div>", "<!-- ", "<p>x</div>", "<script><", "<b>x", "<li><p>", "&amp;", "<p a=", "</p"):
        html.parsed(source * 40_000)
    assert time.time() - began < 30


def sites(spark):
    note = "<div><p>Read our <b>rules</b>.</p></div>"
    rows = [(i, "http://A.example/x", f"<p>Story {i}</p>{note}<p>shared by two</p>" if i < 2 else f"<p>Story {i}</p>{note}", "k") for i in range(8)]
    # Copies of one page are no template; nor are pages of few, or of another site.
    rows += [(20 + i, "https://b.example", "<p>Copy</p><p>of one page</p>", "k") for i in range(30)]
    rows += [(60 + i, "ftp://c.example?x", f"<p>{i}</p>{note}", None) for i in range(4)]
    rows += [(80, "http://d.example/", note, "k"), (81, None, note, "k"), (82, "no host", note, "k"), (83, "http://a.example#y", None, "k"), (None, "http://a.example", note, "k"), (0, "http://a.example", "", "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, subtrees string")


@pytest.mark.parametrize("head", [10_000, 1])
def test_templates(spark, head, monkeypatch):
    monkeypatch.setattr(html.skew, "HEAD", head)
    got = html.extracted(sites(spark).repartition(7)).collect()
    assert len(got) == 48
    by = {r.page_id: r.text for r in got if r.page_id}
    assert [by[i] for i in (1, 2, 7)] == ["Story 1\n\nshared by two", "Story 2", "Story 7"]
    assert by[20] == by[49] == "Copy\n\nof one page"
    assert by[60] == "0\n\nRead our rules." and by[80] == by[81] == by[82] == "Read our rules."
    assert by[83] == "" and sorted(r.text for r in got if r.page_id is None) == [""]
    assert sorted(r.text for r in got if r.page_id == 0) == ["", "Story 0\n\nshared by two"]
    assert html.extracted(sites(spark).where("false")).collect() == []


def test_a_very_long_page(spark):
    df = spark.createDataFrame([(1, "http://a.example", "<article>" + "<p>some words</p>" * 100_000)], "page_id long, url string, html string")
    assert html.extracted(df).select("n_chars").first()[0] == 100_000 * 12 - 2
