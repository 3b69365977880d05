from __future__ import annotations

import html
import re
from itertools import product

import numpy as np
import pytest

from marisma.llm import main_text as M

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field():
    return M.fit_field(M.training_set())


def test_held_out_pages(field):
    right = whole = total = 0
    held = M.training_set(300, seed=99)
    for features, labels in held:
        found = field.decode(field.score(features))
        right += sum(a == b for a, b in zip(labels, found, strict=True))
        total += len(labels)
        whole += labels == found
    assert right >= 0.98 * total and whole >= 0.85 * len(held)


def test_given_pages(spark, field):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in M.main_texts(pages, field).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(x.replace("<br>", " "))).strip() for x in re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", "")))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def blocks(page):
    return [b.text for b in M.leaf_blocks(page)]


def test_leaf_blocks():
    assert blocks("<p>a <b>b</b>\n c<br>d<p>e</p>f") == ["a b c d", "e", "f"]
    assert blocks("<ul><li>one<li>two <i>x</i></ul><table><tr><td>1<td>2</table>") == ["one", "two x", "1", "2"]
    assert blocks("<script>var t='</p><p>no'</script><style>p{}</style><!-- no <p> --><p>a&amp;b &lt;c&gt; &#233;&nbsp;&eacute</p>") == ["a&b <c> é é"]
    assert blocks('<p title="a>b">x</p><p>1 < 2 and 3</p><template><p>no</p></template>') == ["x", "1 < 2 and 3"]
    assert blocks("<div>a<div>b</div>c</div></div></p>d<p") == ["a", "b", "c", "d"]
    assert blocks("") == blocks("<p> \n</p><br>") == [] and blocks("plain") == ["plain"]
    assert blocks("<p>cut <!-- never closed <p>no") == ["cut"] and blocks("<script>never closed <p>no") == []
    assert blocks("<p title=it's>a</p><p>b's</p><a href='x>y' rel=\"z\">c</a>") == ["a", "b's", "c"]
    deep = "<div>x" * 30_000
    assert len(blocks(deep + "</section>" * 30_000)) == 30_000
    assert blocks("<TITLE>no</TITLE><P CLASS=x>Yes</P>") == ["Yes"]


def test_heads_without_an_end(field):
    page = "<html><head><title>T</title><article><h1>Title</h1><p>A paragraph with words enough to be one.</p></article>"
    assert blocks(page) == ["Title", "A paragraph with words enough to be one."]
    assert M.text_of(page, field) == M.text_of(page.replace("<article>", "</head><body><article>"), field) != ""
    assert blocks("<head><meta name=a><style>p{}</style> <template><p>no</p></template>\n<link>Words<p>more") == ["Words", "more"]
    assert blocks("<head><html><head><title>T</title><br>a<div>b") == ["a", "b"]
    assert blocks("<head><script>var t='<p>no'</script><noscript><p>no</p></noscript></head><body><p>x") == ["x"]


def test_ancestors_and_names():
    (b,) = M.leaf_blocks('<main id="Main"><div class="ad-box x2"><p>buy <a href="/">now</a></p></div></main>')
    assert set(b.above) == {"bias", "in main", "in div", "in p", "name main", "name ad", "name box", "name x", "own p", "up div p", "home", "home div", "home p"} and b.linked == 3
    assert "name hidden" in M.leaf_blocks("<p hidden>x</p>")[0].above
    one, two, three = M.leaf_blocks("<article><div><p>a</p></div><main><p>b</p></main></article><p>c</p>")
    assert {"home div", "home p"} <= set(one.above) and "home div" not in two.above and {"in article", "home p"} <= set(two.above)
    assert set(three.above) == {"bias", "in p", "own p", "up p", "away"}


@pytest.mark.parametrize("depth", [3, 70, 400])
def test_an_ancestor_counts_at_any_depth(depth):
    page = "<div>" * depth + '<nav class="menu">' + "<div>" * depth + "<p>x</p>"
    assert {"in nav", "name menu", "own p", "up div p"} <= set(M.leaf_blocks(page)[0].above)


LINES = [
    "The town council met on Tuesday to talk about the new bridge over the river.", "Work will begin in the spring, said the mayor, and last two years.",
    "Not everyone is happy with the plan.", "Shops near the old bridge fear that fewer people will come by.", "A vote is expected before the summer.",
]
TITLE, FOOT = "Council votes on bridge", "<footer><p>© 2024 The Daily. All rights reserved.</p></footer>"
TOP = '<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/s">Sport</a></li></ul></nav>'
LAYOUTS = {
    "div in article": TOP + "<article><div><h1>{t}</h1>{p}</div></article>{f}</body></html>",
    "ten divs in article": TOP + "<article>" + "<div>" * 10 + "<h1>{t}</h1>{p}" + "</div>" * 10 + "</article>{f}</body></html>",
    "title before the div": TOP + "<article><h1>{t}</h1><div>{p}</div></article>{f}</body></html>",
    "plain div": TOP + "<div><h1>{t}</h1>{p}</div>{f}</body></html>",
    "plain div alone": "<html><body><div><h1>{t}</h1>{p}</div>{f}</body></html>",
    "bare body": "<html><body><h1>{t}</h1>{p}{f}</body></html>",
    "table": "<html><body><table><tr><td><a href='/'>Home</a> <a href='/s'>Sport</a></td><td><h1>{t}</h1>{p}</td></tr></table>{f}</body></html>",
    "main": TOP + "<main><h1>{t}</h1>{p}</main>{f}</body></html>",
    "article": TOP + "<article><h1>{t}</h1>{p}</article>{f}</body></html>",
    "section": TOP + "<section class='story'><h1>{t}</h1>{p}</section>{f}</body></html>",
    "nested classes": TOP + "<div id='wrapper'><div class='content'><div class='post'><h1>{t}</h1><div class='entry'>{p}</div></div></div></div>{f}</body></html>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_written_by_hand(field, layout):
    """Short and long articles that end the page or do not: nothing is lost at its edges."""
    for count in (1, 2, 3, 5):
        for foot in ("", FOOT):
            page = LAYOUTS[layout].format(t=TITLE, p="".join(f"<p>{x}</p>" for x in LINES[:count]), f=foot)
            assert M.text_of(page, field) == "\n".join([TITLE, *LINES[:count]])


def test_paragraphs_and_nothing_else(field):
    for count in (2, 3, 5):
        for foot in ("", FOOT):
            assert M.text_of("<html><body>" + "".join(f"<p>{x}</p>" for x in LINES[:count]) + foot, field) == "\n".join(LINES[:count])


def test_cells_of_a_layout_table_around_the_article(field):
    cell = "".join(f"<p>{x}</p>" for x in LINES)
    page = f"<table><tr><td><p><a href='/'>Home</a></p><p><a href='/n'>News</a></p></td><td><h1>{TITLE}</h1>{cell}</td></tr><tr><td>© 2024 The Daily. All rights reserved.</td></tr></table>"
    assert M.text_of(page, field) == "\n".join([TITLE, *LINES])


def test_parts_of_a_page(field):
    page = """<html><body><header class="site-header"><h1>Daily</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
      <div class="cookie-notice"><p>We use cookies.</p></div>
      <article><h1>Title</h1><p>First &amp; long paragraph, with words enough to be one.</p><div class="ad">Buy this now.</div>
      <h2>Part</h2><ul><li>Point one.</li><li>Point two.</li></ul><p>Last paragraph of the article.</p></article>
      <aside class="sidebar"><p>Most read stories of the week.</p></aside>
      <section class="comments"><p>I do not agree with this at all, sorry.</p></section>
      <form action="/s"><p>Subscribe</p><input name="q"></form><footer><p>© 2024 Daily. All rights reserved.</p></footer></body></html>"""
    assert M.text_of(page, field) == "Title\nFirst & long paragraph, with words enough to be one.\nPart\nPoint one.\nPoint two.\nLast paragraph of the article."


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        f = M.Field({}, np.zeros(0), rng.normal(0, 2, (2, 2)))
        scores = rng.normal(0, 2, n).tolist()

        def value(y, f=f, scores=scores):
            return sum(s for s, k in zip(scores, y, strict=True) if k) + sum(f.steps[a, b] for a, b in zip(y, y[1:], strict=False))

        assert np.isclose(value(f.decode(scores)), max(value(y) for y in product((0, 1), repeat=n)))
    pages = [([["a"], ["b"], ["a"]], [1, 0, 1]), ([["b"]], [0]), ([["a"], ["a"]], [1, 1])]
    f = M.fit_field(pages, steps=300)
    assert all(f.decode(f.score(x)) == y for x, y in pages)


def test_odd_rows(spark, field):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, None, "<nav>only menu</nav>", "x"), (3, "u", "<article>" + "<p>word word.</p>" * 8000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, len(r.text), r.n_chars) for r in M.main_texts(df, field).collect()), key=str)
    assert got == sorted([(None, None, 0, 0), (1, "u", 0, 0), (1, "u", 0, 0), (2, None, 0, 0), (3, "u", 8000 * 11 - 1, 8000 * 11 - 1)], key=str)
    assert M.main_texts(df.limit(0), field).collect() == []
