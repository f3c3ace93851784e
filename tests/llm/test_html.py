import random
import time

import pytest

from scholion.llm.html import extract_text, render

CASES = [
    ("<p>One<p>Two <b>bold</b>text<br>next", "One\n\nTwo boldtext\nnext"),
    ("a<div>b</div>c", "a\nb\nc"),
    ("  x \n y&amp;&lt;z&nbsp;!", "x y&<z\xa0!"),
    ("<ul><li>a<li>b<ol><li>c<li>d</ol><li>e</ul>f", "- a\n- b\n  1. c\n  2. d\n- e\n\nf"),
    ("<table><tr><td>a<td>bbb<tr><td>long one<td>c</table>after", "a         bbb\nlong one  c\n\nafter"),
    ("<table><caption>T</caption><tr><th colspan=2>head<th>x<tr><td>1<td>2<td>3</table>", "T\nhead  x\n1  2  3"),
    ("<head><title>no</title></head><script>var a='<p>no'</script><style>p{}</style><body>yes", "yes"),
    ("<p hidden>no</p><div style='color:red; display : none'>no<p>no</div><p style='visibility:hidden'>no</p>yes", "yes"),
    ("<!-- no --><!doctype html>a<![CDATA[b]]>c<unknown>d</unknown>", "abcd"),
    ("<pre>  keep\n   this</pre>x", "  keep\n   this\n\nx"),
    ("5 < 6 and <3 </> ok", "5 < 6 and <3 ok"),
    ("text<p", "text"),
    ("<b><p>in</b> still</p>out", "in still\n\nout"),
    ("<textarea><p>raw</textarea>", "<p>raw"),
    ("<dl><dt>term<dd>what<dt>next<dd>that</dl>", "term\n  what\nnext\n  that"),
    ("<title>x</title>shown", "shown"),
    ("</p></div></td>a</b>", "a"),
    ("<tr><td>a</td><td>b</td></tr>", "a\nb"),
    ("<table><tr><td>o<table><tr><td>i<td>j</table><td>p</table>", "o     p\n\ni  j"),
    ("<a title='a>b' href=x>link</a>", "link"),
    ("", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_render(page, want):
    assert render(page) == want


def test_all_visible_words_stay():
    """A tree that is built here, with what is visible known beforehand."""
    r = random.Random(1)

    def make(depth, seen, out, words):
        word = f"w{len(words)}"
        words.append(word)
        if seen:
            out.append(word)
        parts = [word + " "]
        for _ in range(r.randrange(0, 4) if depth < 6 else 0):
            name = r.choice(["div", "span", "section", "b", "ul", "blockquote", "i hidden", "div style='display:none'"])
            inner = make(depth + 1, seen and "hidden" not in name and "none" not in name, out, words)
            parts.append(f"<{name}>{'<li>' if name == 'ul' else ''}{inner}</{name.split()[0]}> ")
        return "".join(parts)

    for _ in range(50):
        out = []
        page = make(0, True, out, [])
        assert [w for w in render(page).split() if w != "-"] == out


def test_hostile_pages_take_little_time():
    began = time.time()
    for page in ("<div>" * 50000 + "x", "<ul><li>" * 20000 + "x", "<b>" * 50000 + "</i>" * 50000, "<table><tr><td>" * 3000 + "x", "<" * 100000, "<a " * 50000, "<!--" * 50000, "&" * 100000, "<p title='" * 20000, "<li>x" * 50000):
        assert "x" in render(page) or "x" not in page
    assert time.time() - began < 20


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, "t"), (3, "", "t")], "page_id long, html string, text string")
    got = sorted((tuple(r) for r in extract_text(df).collect()), key=str)
    assert got == [(1, "a"), (1, "a"), (3, ""), (None, "")]
    assert extract_text(df.limit(0)).collect() == []


def test_cells_that_reach_down():
    page = "<table><tr><td rowspan=2>a<td>b<td rowspan=3>c<tr><td>d<tr><td>e<td>f<tr><td>g<td>h<td>i</table>"
    assert render(page).split("\n") == ["a  b  c", "   d", "e  f", "g  h  i"]
    assert render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>").split("\n") == ["a  b", "   c", "   d"]


def test_formulas_and_drawings_are_seen():
    assert render("x <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> y") == "x a+b y"
    assert render("<svg><title>t</title><desc>d</desc><text>label</text></svg>") == "label"
