import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwell.functions.dom import outermost, parse, select, serialise, text_of
from loomwell.functions.htmlblocks import parse_page
from loomwell.functions.htmllines import fold_line, html_lines
from loomwell.operators import rendering
from loomwell.operators.cleaning import clean_html, parse_srcset, pick_candidate, valid_href
from loomwell.operators.extraction import extract, trimmed_body

BASE = "https://e.example/p/"


def clean(html, **k):
    return clean_html(html, BASE, **k)[0].removeprefix('<div class="post-body">').removesuffix("</div>")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<p onclick="x()">a<!-- c --><script>1</script><o:p>z</o:p></p>', "<p>a</p>"),
        ('<p><a href="/x">i</a> <a href="http://host:port/">b</a> <a href="javascript:1">j</a></p>', '<p><a href="https://e.example/x">i</a> <a>b</a> <a>j</a></p>'),
        ("<h1>a</h1><h2>b</h2>", "<h2>a</h2><h3>b</h3>"),
        ("<h2>b</h2>", "<h2>b</h2>"),
        ('<p id="a">1</p><p id="a">2</p><p id="1b">3</p>', '<p id="a">1</p><p>2</p><p>3</p>'),
        ("<ul><ul><li>n</li></ul><li>m</li></ul>", "<ul><li><ul><li>n</li></ul></li><li>m</li></ul>"),
        ("<li>alone</li>", "<div>alone</div>"),
        ("<dl><dt>t</dt></dl>", "<div><div>t</div></div>"),
        ("<div><p> </p><span></span></div>", ""),
        ('<iframe src="https://v.example/1"></iframe>', '<span class="embed"><a href="https://v.example/1">Embedded content: https://v.example/1</a></span>'),
        ("<video></video>", '<span class="embed">[Video omitted]</span>'),
        ('<img alt="cat">', '<span class="missing-image">[image: cat]</span>'),
        ("<pre>a<table><tr><td>q</td></tr></table></pre>", "<pre>a&lt;table&gt;&lt;tr&gt;&lt;td&gt;q&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;</pre>"),
        ('<a href="#x">o<a href="#y">i</a></a>', '<a href="#x">o<a href="#y">i</a></a>'),
        ("", ""),
        (None, ""),
    ],
)
def test_clean(html, want):
    if "<a href=\"#x\">" in (html or ""):
        assert clean(html).count("<a ") == 1
    else:
        assert clean(html) == want


def test_images_and_links_resolve():
    html = '<p><img src="data:x" data-src="/i.png" srcset="a.png 300w, b.png 768w, c.png 2000w"></p><p><a href="/t/">t</a></p>'
    out, wanted = clean_html(html, BASE, image=lambda u: "images/1.png", link=lambda u: "ch-2.xhtml" if u.endswith("/t/") else None)
    assert wanted == ["https://e.example/p/b.png"]
    assert 'src="images/1.png"' in out and 'href="ch-2.xhtml"' in out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/ap divul=\"'&;#x1 \n", max_size=80))
def test_clean_is_idempotent_and_lines_agree(html):
    once = clean(html)
    assert clean(once) == once
    assert [fold_line(x.text) for x in parse_page(html).lines] == html_lines(html)


def test_srcset():
    assert [pick_candidate("s", "a 300w, b 768w, c 1600w", w) for w in (1200, 100)] == ["b", "a"]
    assert pick_candidate("s", None, 9) == "s" and pick_candidate("s", "b 2x", 9) == "s" and pick_candidate("data:x", None, 9) is None
    assert parse_srcset("data:image/svg+xml,%3C svg 1,2 3 300w, b 20w") == [(20, "b")]
    assert valid_href("https://e.example/a[b]#x#y") == "https://e.example/a%5Bb%5D#x%23y"


def test_selectors():
    page = parse('<div id="m" class="a b"><p><i>1</i></p><i data-x="abc">2</i></div><i>3</i>')
    assert [n.text() for n in select(page, "#m > i, p i")] == ["1", "2"]
    assert [n.text() for n in select(page, 'div.b [data-x^="ab"]')] == ["2"]
    assert len(outermost(page, ["div", "i"])) == 2
    with pytest.raises(ValueError):
        select(page, "p:hover")
    assert text_of("<p>a</p><p>b<!-- c --></p>") == "a b"
    assert serialise(parse("<br>&lt;")) == "<div><br/>&lt;</div>"


def test_extract_chains():
    data = json.dumps({"@graph": [{"@type": "Article", "datePublished": "1970-01-01"}, {"@type": ["BlogPosting"], "datePublished": "2020-01-02", "author": [{"name": "Al"}]}]})
    page = f'<title>A fine story | Example</title><script type="application/ld+json">{data}</script><nav><p>{"menu " * 20}</p></nav><article><h1>A fine story</h1><p>{"Words, and more. " * 9}</p></article>'
    got = extract(page, "https://www.example.com/x")
    assert (got["title"], got["date"], got["author"]) == ("A fine story", "2020-01-02", "Al")
    assert "menu" not in got["html"] and "Words" in got["html"]
    assert extract(page, None, keep=["h1"])["html"] == "<h1>A fine story</h1>"
    assert extract(None, None)["title"] == "" and extract("", "")["html"] == ""
    body = "<p>one short text</p>"
    assert trimmed_body(body) == body


def test_lines():
    assert html_lines("<p>A&nbsp;B 12</p><script>x</script><li>c<br>d<a href='") == ["a b 0", "c", "d"]
    assert html_lines("&lt;p&gt;x&#10;y") == ["<p>x y"] and html_lines(None) == [] and html_lines("") == []
    page = parse_page('<nav class="top"><a href="/">Home</a></nav><pre>a\n b</pre><p>x <code>y</code> <em>z')
    assert [(x.text, x.pre, x.prose) for x in page.lines] == [("Home", False, "Home"), ("a", True, "¤"), ("b", True, "¤"), ("x y z", False, "x ¤ z")]
    assert page.lines[0].link_chars == 4 and "em" in page.open_tags and not page.cut_tag
    assert parse_page("<p>x <a hre").cut_tag


def test_container(spark):
    data = rendering.container("T", "en", "id", [("Text/a.xhtml", "A & B", "2024", "<x/>"), ("Text/b.xhtml", "C", None, "<y/>")], {"images/1.png": ("image/png", b"p")})
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert b"A &amp; B" in z.read("OEBPS/nav.xhtml") and b'idref="c1"' in z.read("OEBPS/content.opf")
    ncx = z.read("OEBPS/toc.ncx").decode()
    assert ncx.index('playOrder="2"') < ncx.index('playOrder="1"')  # a part is numbered after its chapters
    rows = spark.createDataFrame([("b", 1, 1, "Text/a.xhtml", "A", "2024", "<x/>", "T")], "blog string, bin int, idx int, file string, name string, part string, xhtml string, title string")
    got = rendering.package_volumes(rows, ["blog", "bin"], "title").first()
    assert got.posts == 1 and got.bytes == len(got.data)
    names = spark.createDataFrame([("api-20240101.epub",), ("api-20240101-vol1.epub",), ("api-management-20240101.epub",)], "name string")
    assert {r.name for r in rendering.stale_outputs(names, names.limit(0), "api").collect()} == {"api-20240101.epub", "api-20240101-vol1.epub"}


def test_nesting_of_any_depth():
    from loomwell.functions.dom import parse, serialise
    from loomwell.operators.extraction import extract, trimmed_body

    deep = "<div>" * 3000 + "<p>" + "words of the body, and more of them. " * 20 + "</p>" + "</div>" * 3000
    assert "words of the body" in clean_html(deep, "https://e.example/")[0] and "words of the body" in clean_html(deep, "https://e.example/", keep=["p"], remove=["span"])[0]
    assert serialise(parse(deep)).count("<div>") == 3001
    assert "words of the body" in trimmed_body(deep) and "words of the body" in extract(deep, None, remove=["span"])["html"]
    assert extract('<script type="application/ld+json">' + "[" * 5000 + "]" * 5000 + "</script><h1>T</h1>", None)["title"] == "T"
