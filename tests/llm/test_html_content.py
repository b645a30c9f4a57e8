"""The scan of HTML, messages against enumeration, and main text of pages of many kinds."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from sparkloom.llm import html_content, html_pages, html_tree

A = "The river rose slowly through the night. By morning the lower fields were under water, and nobody in the village was surprised."
B = "Old people said it had been worse before. They pointed at the mark on the mill wall."
PAGES = {
    "all_regions": (f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";track(0);</script></head><body><header><h1>My Site</h1><p>All the news you need, every single day.</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies to improve your experience. By continuing you agree.</div><div class="ad">Buy now. Great offers every day.</div><article><h1>Title</h1><p>{A}</p><div class="ad">Buy this thing. It is cheap and good.</div><p>{B}</p><p>Short line.</p><ul><li>one thing</li><li>other thing</li></ul></article><aside><h3>Related</h3><p>Another story that is long enough to be read as text. It has two sentences.</p></aside><section class="comments"><h2>Comments</h2><p>I really liked this article. It made me think of my grandmother.</p><p>Me too.</p></section><form><label>Email</label><p>Sign up for our letter.</p></form><footer>&copy; x.com &middot; words</footer></body></html>', f'Title\n{A}\n{B}\nShort line.\none thing\nother thing'),
    "div": (f'<body><div id="header"><a href=/>Blog</a></div><div id="menu"><a href=1>One</a> | <a href=2>Two</a></div><div id="wrap"><div class="post"><h2>Title here</h2><div class="entry"><p>{A}</p><p>{B}</p></div></div><div id="respond"><h3>Leave a reply</h3><form><p>Name</p></form></div><div id="comments"><h3>2 comments</h3><ol class="commentlist"><li>Anna says: {B}</li><li>Bob says: {A}</li></ol></div></div><div id="sidebar"><h3>Archive</h3><ul><li><a>May</a></li></ul></div><div id="footer">Copyright 2004. All rights reserved.</div></body>', f'Title here\n{A}\n{B}'),
    "bare": (f'<h1>Only</h1><p>{A}<p>{B}', f'Only\n{A}\n{B}'),
    "plain": (f'{A}\n{B}', f'{A} {B}'),
    "main": (f'<body><nav class="menu"><a href=1>Home</a></nav><main><h1>Head</h1><p>{A}</p><aside class="sidebar"><p>Short line.</p></aside><p>{B}</p></main><div role="alert" class="notice">{B}</div><footer><p>Imprint</p></footer>', f'Head\n{A}\n{B}'),
    "commentsarticle": (f'<body><main><article><header><h1>Head</h1></header><p>{A}</p></article><section id="comments"><article class="comment"><p>{B}</p></article><article class="comment"><p>Short line.</p></article></section></main></body>', f'Head\n{A}'),
    "inarticle": (f'<body><article><h1>Head</h1><p>{A}</p><nav><ul><li><a href=1>Next part</a></li></ul></nav><form><p>Subscribe to us. It is free.</p><input></form><p>{B}</p><div class="share">Share on: X, Y</div><section class="comments"><p>{B}</p></section><footer>Filed under words.</footer></article><div class="newsletter-signup">Get our letter.</div></body>', f'Head\n{A}\n{B}'),
    "empty": (f'', f''),
    "oneword": (f'<html><body><nav><ul><li><a href=x>a</a></li></ul></nav><article><h1>Auxpa.</h1><p>Auxpa.</p></article><footer>&copy; z</footer></body>', f'Auxpa.\nAuxpa.'),
    "contentdiv": (f'<html><body><div class="header">Site</div><div class="nav"><ul><li><a href=1>A b c</a></li><li><a href=2>D</a></li></ul></div><div class="content"><h1>T</h1><p>{A}</p><p>{B}</p></div><div class="sidebar">{B}</div><div class="comments"><p>{A}</p></div><div class="footer">x</div></body>', f'T\n{A}\n{B}'),
    "noscript": (f'<body><noscript>Enable scripts.</noscript><div class="banner">{B}</div><article><p>{A}</p><figure><img><figcaption>Cap of it</figcaption></figure><table><tr><td>1</td><td>two</td></tr></table><blockquote>{B}</blockquote><pre>a  b\nc</pre></article><div class="popup">Join us</div>', f'{A}\nCap of it\n1\ntwo\n{B}\na b c'),
    "sectionpage": (f'<body><header class="site-header"><div class="logo">N</div></header><section class="hero ad">Win a prize today. Click here.</section><section class="story"><h1>Q</h1><p>{A}</p><p>{B}</p></section><section class="related"><h2>More</h2><p>Something else happened yesterday in the town.</p></section><section class="discussion"><p>{A}</p></section></body>', f'Q\n{A}\n{B}'),
}


@pytest.fixture(scope="module")
def model():
    return html_content.trained()


def blocks(page):
    return [t for t in html_tree.parse(page).text if t is not None]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("a &lt; b &amp c &#8217; &copy", ["a < b & c \u2019 \u00a9"]), ("x<!-- <p>no --> y<!-->z", ["x yz"]), ("<p>a<p>b</p>c</p>d", ["a", "b", "c", "d"]), ("a<br>b <b>c</b>\n\td", ["a b c d"]),
        ("<script>'</p>'</script><style>p{}</style>a<noscript>b</noscript><textarea>c</textarea>", ["a"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<p title='a > b'>x</p", ["x"]), ("<title>t</title>1 < 2 <3 a", ["1 < 2 <3 a"]), ("<head><title>t</title><p>x", ["x"]), ("<div></section></div>x</div>", ["x"]), ("a<select><option>b</select><button>c</button> d<div>e<svg>f</div>g", ["a d", "e", "g"]), ("a<script>b", ["a"]), ("<SCRIPT>b</ScRiPt >c", ["c"]),
    ],
)
def test_blocks_of_markup(page, want):
    assert blocks(page) == want


def test_a_deep_or_broken_page_takes_linear_time():
    for unit in ("<div>", "</div>", "<div><p>", "<a b=\"", "<!--", "<td>", "<li><blockquote>"):
        html_tree.parse(unit * 50_000 + "x")


def test_messages_give_the_marginals_of_all_states():
    rng = np.random.default_rng(2)
    trees = [html_tree.parse("<div><p>a</p><p>b<section><ul><li>c</ul></section></div>d"), html_tree.parse("x"), html_tree.parse("<article><h1>y</h1>z</article>")]
    f = html_content.forest(trees, {})
    pairs, score = rng.normal(size=(html_content.KINDS**2, 2, 2)) * 2, rng.normal(size=len(f.tag)) * 2
    got, joint = html_content.sum_product(f, score, pairs)
    kind = f.pair()
    for page in range(len(trees)):
        nodes = np.flatnonzero(f.page == page)
        total, one, two = 0.0, dict.fromkeys(nodes, 0.0), {n: np.zeros((2, 2)) for n in nodes}
        for states in itertools.product((0, 1), repeat=len(nodes)):
            state = dict(zip(nodes, states, strict=True))
            weight = np.exp(sum(score[n] * s for n, s in state.items()) + sum(pairs[kind[n], state[f.parent[n]], s] for n, s in state.items() if f.parent[n] >= 0))
            total += weight
            for n, s in state.items():
                one[n] += weight * s
                if f.parent[n] >= 0:
                    two[n][state[f.parent[n]], s] += weight
        for n in nodes:
            assert got[n] == pytest.approx(one[n] / total)
            if f.parent[n] >= 0:
                assert joint[n] == pytest.approx(two[n] / total)


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text_without_what_stands_around_it(model, name):
    page, want = PAGES[name]
    assert html_content.texts([page], model) == [want]


def test_made_pages_that_were_not_learned_from(model):
    trees = [html_tree.parse(p) for p in html_pages.labelled_pages(400, seed=99)]
    f = html_content.forest(trees, model.vocabulary)
    leaf = f.tag == html_content.TAG["#text"]
    right = (model.marginals(f) >= 0.5) == html_content.targets(trees, f)
    assert right[leaf].mean() > 0.985


def test_rows_of_any_kind(spark, model):
    long = "<article>" + "<p>word word word.</p>" * 40_000 + "</article>"
    rows = [(1, None, "u", 5), (2, "", None, 5), (None, "<p>a</p>", "v", 5), (3, "<p>a</p>", "v", 5), (3, "<p>a</p>", "v", 5), (4, " \n", "w", 5), (5, long, "l", 5)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string, n_chars int").repartition(2)
    got = sorted(html_content.extract(df, "html", model).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.n_chars) for r in got] == [(None, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, 40_000 * 16 - 1)]
    assert df.columns != html_content.extract(df, "html", model).columns == ["page_id", "text", "n_chars"]
    assert html_content.extract(df.filter("page_id > 9"), "html", model).collect() == []
