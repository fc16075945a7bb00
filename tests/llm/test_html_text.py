import re
import time
from html.parser import HTMLParser

import pytest

from locusloom.llm.html_text import extract, render


class Visible(HTMLParser):
    """Words of a well-formed page outside script, style and head."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "head")
        self.words.append(" ") if tag not in ("b", "i", "a", "em", "span") else None

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_all_visible_words_of_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        plain = Visible()
        plain.feed(re.sub(r"<br\s*/?>", " ", r.html))
        words = [w for w in texts[r.page_id].split() if w != "-"]
        assert words == "".join(plain.words).split()


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a<p>b", "a\n\nb"), ("x<br>y<br><br>z", "x\ny\n\nz"), ("<b>a</b> <i>b</i>c", "a bc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=9><li>a<li>b<li value=20>c</ol>", "9. a\n10. b\n20. c"), ("<dl><dt>k<dd>v<dd>w</dl>", "k\n  v\n  w"),
    ("<table><tr><th>n<th>amount<tr><td>pear<td>1</table>", "n     amount\npear  1"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide     z\na     b  c"),
    ("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>", "r  a\n   b"), ("<table><td>no row</table>", "no row"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"), ("<p hidden>a<p>b", "b"), ("<div style='display : NONE'>a<div>b</div></div>c", "c"),
    ("<script>'<p>x'</script><style>p{}</style><noscript>n</noscript>a<!-- <p>c -->b", "ab"), ("<script>never closed <p>x", ""),
    ("&lt;p&gt;&amp;nbsp;&eacute;", "<p>&nbsp;é"), ("a < b > c", "a < b > c"), ("<a href='x>y'>z</a>", "z"), ("<a href=\"u>z", "z"),
    ("<details><summary>s</summary>body</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<title>t</title>b", "b"), ("<head><title>t</title><p>implied body", "implied body"), ("</p>a</b></div>b", "ab"), ("<b><p>x</b>y</p>z", "xy\n\nz"),
    ("<h1>t</h1><div>a</div><div>b</div>", "t\n\na\nb"), ("<blockquote>q</blockquote>r", "  q\n\nr"), ("", ""), ("<p></p>", ""), ("<a", "<a"),
    ("<textarea>a &amp; <b>\n c</textarea>", "a & <b>\n c"), ("<select><option>a<option>b</select>", "a\nb"), ("a<hr>b", "a\n\nb"),
])
def test_rendering(page, text):
    assert render(page) == text


def test_deep_and_long_pages():
    assert render("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert render("<a b=\"" * 3000 + "x").endswith("x")
    assert len(render("<p>word</p>" * 50_000).split()) == 50_000


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (None, "<p>x", "u"), (3, "<p>x", "u"), (3, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted(((r.page_id or 0), r.text) for r in extract(pages).collect() if r.text is not None) == [(0, "x"), (2, ""), (3, "x"), (3, "x")]
    assert extract(pages).count() == 5 and extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("quote", ["'", '"'])
@pytest.mark.parametrize("size", [100, 20_001, 300_000])
def test_long_attribute_values_stay_in_their_tag(quote, size):
    page = f"<div data-x={quote}{'y' * size}<b>leak</b> more{quote} hidden>secret</div>shown"
    assert render(page).strip() == "shown"
    assert render(f"<p title={quote}{'y' * size}>a<p>seen").endswith("seen")


HOSTILE = {
    "nested": lambda n: "<div>" * n + "x",
    "nested inline": lambda n: "<b>" * n + "<p>" * n + "x",
    "quotes": lambda n: "<a b=\"" * n + "x",
    "both quotes": lambda n: "<a b=\"" * n + " ='>'",
    "names": lambda n: "<a" * n + " ='>'",
    "stray ends": lambda n: "<b>" * n + "</i>" * n + "x",
    "raw": lambda n: "x<script>" + "</script " * n,
    "quoted blocks": lambda n: "<blockquote>x" * n,
    "tables": lambda n: "<table><tr><td>x" * n,
    "captions": lambda n: "<table><caption>x" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_length(name):
    def seconds(n):
        page = HOSTILE[name](n)
        start = time.process_time()
        assert "x" in render(page) or name in ("both quotes", "names")
        return time.process_time() - start

    seconds(2000)
    # quadratic work would take four times as long, and minutes at this size
    assert min(seconds(20_000), seconds(20_000)) < 3 * min(seconds(10_000), seconds(10_000)) + 0.5


def test_text_at_every_depth_stays():
    for page in ("<table><tr><td>w" * 60, "<blockquote>w" * 60, "<ul><li>w" * 60, "<table><caption>w" * 60):
        assert render(page).count("w") == 60


def test_tag_without_end_is_text():
    assert render("a <b c=\"d") == "a <b c=\"d"
    assert render("a <b c=\"d> e <i>f</i>") == "a e f"
    assert render("<b<i>x") == "x"
