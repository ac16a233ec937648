import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyfold.llm.html_text import extract, to_text

CASES = {
    "<p>a<p>b <b>c</b>d<br>e": "a\n\nb cd\ne",
    "<ul><li>x<li>y<ol><li>1<li>2</ol><li>z</ul>after": "- x\n- y\n  1. 1\n  2. 2\n- z\n\nafter",
    "<ol start=9><li>a<li>b<li value=20>c</ol>": "9. a\n10. b\n20. c",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>banana split<td>12</table>tail": "Name          Qty\napple         1\nbanana split  12\n\ntail",
    "<table>foo<tr><td colspan=2>wide cell here<tr><td>a<td rowspan=2>b<tr><td>c</table>": "foo\n\nwide cell here\na  b\nc",
    "<table><tr><td>a<br>b<td>c<tr><td><p>d</p><p>e</p><td>f</table>": "a  c\nb\nd  f\n\ne",
    "<title>t</title>hi<script>var a='</p>';</script> there &amp; &lt; &copy;2024<div hidden>no</div><span style='display:none'>no</span>yes": "hi there & < ©2024yes",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b></div>": "yes",
    "<pre>\n a\n   b</pre>x": " a\n   b\n\nx",
    "<div>a</div><div>b</div> c": "a\nb\nc",
    "a &amp b < c > d <e": "a & b < c > d <e",
    "<details><summary>s</summary>hidden</details><p>q": "s\n\nq",
    "<details open><summary>s</summary>shown</details>": "s\nshown",
    "<dl><dt>T<dd>D1<dd>D2</dl>": "T\n    D1\n    D2",
    "<!-- <p>no --><![if x]>a<!doctype html>b": "ab",
    "<style>p{}</style><noscript>no</noscript><template>no</template><textarea>a  &lt;b</textarea>": "a  <b",
    "<p>one</div>two</p></section>three": "onetwo\n\nthree",
    "<select><option>a<option>b</select>": "a\nb",
    "x  y": "x  y",
    "": "",
    "<script>never closed": "",
    "<head><title>t</title></head><p>body": "body",
}


@pytest.mark.parametrize("source", CASES)
def test_layout(source):
    assert to_text(source) == CASES[source]


RAW_CASES = {
    "<title>İ</title><p>body": "body",
    "<div>İİ<script>x</script><p>rest of page</p></div>": "İİ\n\nrest of page",
    "<p>İ<textarea>a</textarea> b<STYLE>p{}</Style >c": "İa bc",
    "<script>'</scripts>'</script>after": "after",
}


@pytest.mark.parametrize("source", RAW_CASES)
def test_raw_text_ends_at_its_own_end_tag(source):
    assert to_text(source) == RAW_CASES[source]


SHOWN_CASES = {
    "<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b": "a x=2 b",
    "<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>": "1 2\n3",
    "<svg><title/><style/><text>Q1</text><text>Q2 <tspan>up</tspan></text></svg> end": "Q1\nQ2 up\nend",
    "<svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs><a>yes</a></svg>": "yes",
    "<svg><text display=none>no</text><g visibility=hidden>no</g><text><![CDATA[a > &amp;]]></text></svg>": "a > &amp;",
    "<svg><foreignObject><p>in</p></foreignObject></svg><svg><defs><path><p>out": "in\n\nout",
    "<map name=m><area><a href=x>place</a></map><desc>html</desc>": "placehtml",
    "a<xmp>\n <b>x</b> &amp;  y</xmp>z": "a\n\n <b>x</b> &amp;  y\nz",
}


@pytest.mark.parametrize("source", SHOWN_CASES)
def test_formulas_charts_maps_and_xmp(source):
    assert to_text(source) == SHOWN_CASES[source]


def test_any_depth_and_length():
    assert to_text("<div>" * 60000 + "deep" + "</div>" * 60000 + "<p>end") == "deep\n\nend"
    assert to_text("<table><tr><td>" * 300 + "cell").strip() == "cell"
    assert len(to_text("<p>w " * 50000).split()) == 50000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<br>", "word", " ", "<pre>", "</pre>", "&amp;", "<dd>", "</x>", "< ", ">", '<a href="x>y">', "<caption>", "<option>"]), max_size=40))
def test_no_visible_word_is_lost(parts):
    text = to_text("".join(parts))
    assert text.count("word") == "".join(parts).count("word")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<svg>", "</svg>", "<text>", "</text>", "<g/>", "<math>", "</math>", "<mi>", "</mi>", "<mtr>", "<mtd>", "<map>", "</map>", "<xmp>", "</xmp>", "<p>", "</p>", "<table>", "<td>", "</table>", "<li>", "<foreignObject>", "<style></style>", "İ", "word", " "]), max_size=40))
def test_no_word_of_formulas_charts_maps_and_xmp_is_lost(parts):
    source = "".join(parts)
    assert to_text(source).count("word") == source.count("word")


def test_column(spark):
    rows = [(1, "<p>a", "x"), (2, None, None), (3, "", "y"), (1, "<p>a", "x"), (None, "b", "z")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, batch string")
    got = extract(df).collect()
    assert [(r["page_id"], r["text"], r["batch"]) for r in got] == [(1, "a", "x"), (2, None, None), (3, "", "y"), (1, "a", "x"), (None, "b", "z")]
    assert extract(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "source",
    [
        "<a " * 350_000, "<a \"" * 250_000 + "'", "<a '" * 125_001 + "<b \">" * 100_000, "</a" * 350_000, "<!" * 500_000,
        "<div>" * 100_000 + "</p>" * 100_000, "<i><table><td>" + "<b>" * 150_000 + "</i>" * 150_000, "a<b>c</b>" * 110_000,
        "<table>" + "<tr><td rowspan=65534 colspan=1000>x" * 20, "x<span></y>" * 90_000,
    ],
    ids=["unclosed", "quotes", "mixed-quotes", "unclosed-ends", "declarations", "p-ends", "walled-ends", "one-line", "spans", "unknown-ends"],
)
def test_broken_pages_of_a_megabyte_take_linear_time(source):
    import time

    begin = time.process_time()
    assert to_text(source) is not None
    assert time.process_time() - begin < 10


def test_markup_is_found_as_the_grammar_says():
    """The scanner against one regular expression of the same grammar."""
    import random
    import re

    from keyfold.llm.html_text import _Scanner

    grammar = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*+)[^>]*>|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng = random.Random(6)
    for _ in range(20_000):
        source = "".join(rng.choices(["<", ">", "/", "a", "b ", '"', "'", "!", "--", "?", " x="], k=rng.randrange(1, 24)))
        scanner, at, got, want = _Scanner(source), 0, [], []
        while found := scanner.next(at):
            got.append((*found[:2], found[3], found[4]))
            at = found[1]
        for m in grammar.finditer(source):
            want.append((m.start(), m.end(), m[1] or m[2] or "", m[3] or ""))
        assert got == want, source


def test_only_the_display_property_hides():
    assert to_text("<p style='xdisplay : none'>a<p style='-x-display:none'>b<p style='color:red;display : none'>c") == "a\n\nb"
