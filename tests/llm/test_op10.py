import html
import re

import numpy as np
import pytest

from neurograph.llm import html_blocks, html_pages, html_text, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return html_text.trained()


def article(page):
    """The known layout of these tables: the blocks of the one article element."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_query_against_known_layout(spark, model):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op10_html_text(spark, SF).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    assert sum(r.text == article(pages[r.page_id].html) for r in rows) >= 0.98 * len(rows)


def test_held_out_pages(model):
    rng, f, right, n, whole = np.random.default_rng(12345), html_text.Features(), 0, 0, 0
    for _ in range(300):
        page, wanted = html_pages.page(rng)
        found = html_blocks.leaves(page)
        marks = [re.search("§[0-9]+¶", b.text) for b in found]
        truth = np.array([m is not None and m[0] in wanted for m in marks])
        said = model.label([f.of([html_blocks.Leaf(b.node, html_pages.unmarked(b.text) or ".", b.linked) for b in found])])[0]
        right, n, whole = right + (said == truth).sum(), n + len(truth), whole + (said == truth).all()
    assert right / n > 0.98 and whole / 300 > 0.85


PAGE = """<html><head><title>T</title></head><body><header><div class="logo">The Site</div><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav></header>
<div class="cookie-banner">We use cookies. <button>Accept</button></div><main><h1>A long&nbsp;story &amp; more</h1><p>First paragraph of the story, with <b>bold</b> and <a href="x">linked</a> words, quite long.</p>
<div class="ad">Buy cheap things now</div><p>Second   paragraph
goes on here with more words, &lt;p&gt; and 5 &gt; 4.</p><ul><li>A point that is made</li><li>Another point is made</li></ul></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="1">Other story</a></li></ul></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>Great story, I liked it very much.</p></div></section>
<form><label>Name</label><input><textarea>x</textarea></form><footer>&copy; 2024 The Site. All rights reserved.</footer><script>if (a < b) { "<p>no</p>" }</script></body></html>"""


def test_one_page(model):
    got = html_text.main_text([PAGE], model, html_text.Features())[0]
    assert got == "A long story & more\n\nFirst paragraph of the story, with bold and linked words, quite long.\n\nSecond paragraph goes on here with more words, <p> and 5 > 4.\n\nA point that is made\n\nAnother point is made"


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []), ("plain text", ["plain text"]), ("<p>a<p>b<br>c", ["a", "b c"]), ("<p>a<script>x<p></script>b", ["ab"]), ("a<!-- <p>x -->b", ["ab"]), ("<p>a <", ["a <"]), ("<p>x<b", ["x"]), ("<div>a<span>b</span></div>c", ["ab", "c"]),
        ("<li>a<li>b</ul>c", ["a", "b", "c"]), ("<p title='>'>a", ["a"]), ("&am &amp &#65;&#x42;", ["&am & AB"]), ("<style>p{}", []), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<a href=x>l</a> t", ["l t"]), ("</p></b>x", ["x"]), ("<title>t</title>\x00<P CLASS=Big>Y", ["\x00", "Y"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in html_blocks.leaves(page)] == texts


def test_paths():
    (a, b) = html_blocks.leaves("<div id='mainText' class=\"x-2 y\"><p>a<a href=x>bc</a></p></div><p>d")
    assert a.node.path() == [("div", ".main", ".text", ".x", ".2", ".y"), ("p",)] and a.linked == 2 and b.node.path() == [("p",)]


def test_edges(spark, model):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "a", 1), (2, "u", "", None, 2), (2, "u", "", None, 2), (None, "u", "<p>" * 30_000 + "x", "b", 3), (4, "u", "<div>" * 20_000, "b", 3), (5, "u", "<" * 50_000 + "\"'", "b", 3), (6, "u", "y " * 200_000, "c", 3)]
    out = html_text.extract(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
    assert {r.text for r in out.where("page_id in (1, 2, 4)").collect()} == {""}
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_gradients():
    """Of the loss by each kind of weight, against differences."""
    rng = np.random.default_rng(0)
    lstm = html_text.Lstm(rng)
    x, d = rng.standard_normal((4, 2, html_text.SIZE)).astype(np.float32) * 0.3, rng.standard_normal((4, 2, html_text.HIDDEN)).astype(np.float32)
    kept = []
    lstm.run(x, kept)
    grads = lstm.back(x, d, kept)
    for p, g, at in ((lstm.wx, grads[0], (3, 5)), (lstm.wh, grads[1], (2, 30)), (lstm.wx, grads[0], (7, 80)), (lstm.b, grads[2], (50,))):
        old = p[at]
        p[at] = old + 0.01
        up = (lstm.run(x) * d).sum()
        p[at] = old - 0.01
        down = (lstm.run(x) * d).sum()
        p[at] = old
        assert abs((up - down) / 0.02 - g[at]) < 2e-2 * max(1, abs(g[at]))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>one</p><svg width="5" /><p>two</p>', ["one", "two"]), ("<p>one</p><svg hidden/><p>two</p>", ["one", "two"]), ("<p>one</p><svg><path d=M0><p>two</p>", ["one", "two"]),
        ("<p>a <math><mi>x</mi></math> b</p>", ["a x b"]), ("<object data=x><p>else</p></object><p>two</p>", ["else", "two"]), ("<object data=x><p>one</p>", ["one"]),
        ("<template><p>t</p></template><p>two</p>", ["t", "two"]), ("<svg><title>no</title><text>yes</text></svg><p>two</p>", ["yes", "two"]), ("<math/><p>one</p><script>no<p>no</p></script>", ["one"]),
    ],
)
def test_only_raw_text_is_left_out(page, want):
    """Vector graphics, formulas, objects and templates are elements like others, and lose no text after them."""
    assert [leaf.text for leaf in html_blocks.leaves(page)] == want


@pytest.mark.parametrize("html, want", [
    ("<p title=don't>one</p><p>two</p>", ["one", "two"]), ("<p>a</p><p data-x=it's>b</p><p>c</p>", ["a", "b", "c"]), ('<p>x</p><img alt="a 5" screen" width=3><p>after</p>', ["x", "after"]),
    ('<p title="open>text</p><p>more</p>', ["text", "more"]), ('<p title="u > v">w</p>', ["w"]), ("<a href = 'x>y'>in</a><p =a>z</p>", ["in", "z"]), ('<p a="1"b=\'2\'c>t</p>', ["t"]), ("<p 'lone \" quotes'>t</p><div>u</div>", ["t", "u"]),
])
def test_quotes_inside_tags(html, want):
    """A quote counts right after "=" only, and only if it is closed; else ">" ends the tag."""
    assert [b.text for b in html_blocks.leaves(html)] == want


def test_deep_pages_take_memory_in_proportion(spark):
    """Nested elements with a word each: nodes are shared, so a page of 40,000 levels is read, labelled and returned."""
    import tracemalloc

    page = "".join(f"<div class=c{k % 50}>w{k} " for k in range(40_000))
    tracemalloc.start()
    found = html_blocks.leaves(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 40_000 and found[-1].node.depth == 40_000 and peak < 80_000_000
    df = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert html_text.extract(df).count() == 1


def test_paths_are_shared_and_equal():
    one, two = html_blocks.leaves("<div class='a b'><p id=c>x</p><p id=c>y</p></div>")
    assert one.node is two.node and one.node.path() == [("div", ".a", ".b"), ("p", ".c")]
