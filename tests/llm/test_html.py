import itertools
import random

import numpy as np
import pytest

from revscope.llm import htmlmain as H

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def texts(html):
    return [b.text for b in H.leaf_blocks(html)]


@pytest.mark.parametrize(("html", "want"), [
    (None, []), ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
    ("<p>x &lt;b&gt; &eacute;&#233;&#x41; &nbsp; y</p>", ["x <b> ééA y"]), ("<script>var a='<p>no</p>';</script><p>yes", ["yes"]),
    ("<style>p{}</style><!-- <p>no</p> --><div>a <b>b</b>\n\t c</div>", ["a b c"]), ("<ul><li>1<li>2<ul><li>3</ul></ul>", ["1", "2", "3"]),
    ("<p>cut &am", ["cut &am"]), ("<p>cut <a hre", ["cut"]), ("a < b <i>c</i>", ["a < b c"]), ("<a title='x>y'>t</a>", ["t"]),
    ("<head><title>no</title></head><body>yes", ["yes"]), ("<p>" + "long " * 50_000, [("long " * 50_000).strip()]), ("</div></p>x", ["x"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<textarea><p>no</textarea>a", ["a"])])
def test_leaf_blocks(html, want):
    assert texts(html) == want


def test_ancestors():
    b = H.leaf_blocks('<div class="Side-Bar x"><section id=main><p>t</p></section></div>')[0]
    assert b.path == ("div c=side c=bar c=x", "section c=main", "p")


def random_crf(rng):
    return H.Crf(rng.normal(size=1 << H.HASH_BITS), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))


def total(crf, scores, labels):
    s = crf.start[labels[0]] + crf.end[labels[-1]] + sum(e for e, y in zip(scores, labels, strict=True) if y)
    return s + sum(crf.move[a, b] for a, b in zip(labels, labels[1:], strict=False))


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for n in range(1, 9):
        crf = random_crf(rng)
        scores = rng.normal(size=n).tolist()
        best = max(total(crf, scores, y) for y in itertools.product((0, 1), repeat=n))
        assert total(crf, scores, crf.viterbi(scores)) == pytest.approx(best)
    assert random_crf(rng).viterbi([]) == []


def test_training_climbs_to_the_likelihood_of_enumeration():
    pages = [([[1], [2], [3]], [0, 1, 1]), ([[1], [3]], [0, 1]), ([[2]], [1]), ([[3], [1]], [0, 0])]

    def loss(crf):
        out = 0.0
        for f, y in pages:
            scores = [float(crf.weights[x].sum()) for x in f]
            z = np.logaddexp.reduce([total(crf, scores, c) for c in itertools.product((0, 1), repeat=len(y))])
            out += z - total(crf, scores, y)
        return out

    a, b = H.fit_crf(pages, rounds=5), H.fit_crf(pages, rounds=300)
    assert loss(b) < loss(a) < 7 * np.log(2) and loss(b) < 0.5


def test_drawn_pages_held_out():
    rng = random.Random(3)
    train = []
    for _ in range(H.DRAWN_PAGES):
        html, labels = H.drawn_page(rng)
        train.append((H.features(H.leaf_blocks(html)), labels))
    crf = H.fit_crf(train)
    rng, right, n = random.Random(99), 0, 0
    for _ in range(200):
        html, labels = H.drawn_page(rng)
        blocks = H.leaf_blocks(html)
        right += sum(a == b for a, b in zip(crf.viterbi(crf.emissions(blocks)), labels, strict=True))
        n += len(labels)
    assert right / n > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>x("<p>")</script></head><body>
<header class="site-header"><h1>The Daily</h1><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. Accept them.</p></div>
<div id="content"><h1>Dogs &amp; cats</h1><p>One day a dog met a cat, and they talked.</p><div class="ad">Buy now!</div>
<p>They talked for hours about food, sleep and the weather.</p></div>
<aside class="sidebar"><h3>Related</h3><p><a href=/1>Another story about birds</a></p></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I like this story. It made me laugh.</p></div></section>
<form><label>Your mail</label><input><button>Go</button></form><footer><p>&copy; 2024 The Daily</p></footer></body></html>"""


def test_query_shape_and_defined_cases(spark):
    crf = H.fit(spark.createDataFrame([], SCHEMA))
    rows = [(1, "u", PAGE, "x", 1), (2, None, None, "x", 1), (3, "u", "", None, None), (None, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1)]
    got = H.extract(spark.createDataFrame(rows, SCHEMA), crf).collect()
    want = "Dogs & cats\n\nOne day a dog met a cat, and they talked.\n\nThey talked for hours about food, sleep and the weather."
    assert [r.text for r in got] == [want, "", "", want, want]
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract(spark.createDataFrame([], SCHEMA), crf).count() == 0


def test_testdata_articles(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in H.op6_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = p.html[p.html.index("<article>"):p.html.index("</article>")]
        assert got[p.page_id] == "\n\n".join(texts(inside))


@pytest.mark.parametrize("start", ["<body>", "<body class=x>", ""])
def test_head_without_its_end_tag(start):
    head = "<!doctype html><html><head><meta charset=utf-8><link rel=x><title>no</title><style>p{}</style><script>no()</script>\n"
    assert texts(head + start + "<p>a<p>b <b>c</b>") == ["a", "b c"]
    assert texts(head + start + "plain <i>text</i>") == ["plain text"]
    assert texts(head + "<noscript><link rel=y></noscript>" + start + "<div>a</div>") == ["a"]
    assert texts(head + "<noscript><p>no</noscript><meta name=z></head>" + start + "<div>a</div>") == ["a"]


def test_body_ends_what_is_open_in_a_head():
    assert texts("<head><noscript><link rel=x><body><p>a</p>") == ["a"]
    assert texts("<head><title>no</title></head><body><p>a<noscript>no</noscript>") == ["a"]


@pytest.mark.parametrize("html", ["<div>x" * 170_000, "<b></i>y" * 130_000, "<b>" * 100_000 + "<p>z" * 100_000, "<i><div>" + "<b></i>" * 140_000, '<a x=">' * 140_000,
                                  "".join(f'<div class="k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}x">t' for i in range(40_000))])
def test_a_megabyte_of_deep_or_unbalanced_markup_takes_seconds(html):
    import time

    rng = np.random.default_rng(0)
    began = time.process_time()
    crf = random_crf(rng)
    blocks = H.leaf_blocks(html)
    assert len(crf.emissions(blocks)) == len(blocks)
    assert time.process_time() - began < 40


def test_emissions_are_the_weights_of_the_features():
    rng = np.random.default_rng(4)
    crf = random_crf(rng)
    page = '<body><div class="main a"><p>one, two.</p><i>x</i></div><ul class=a><li>1<li id=side>2</ul>end</body>tail'
    blocks = H.leaf_blocks(page)
    names = H.features(blocks)
    for e, f, b, i in zip(crf.emissions(blocks), names, blocks, range(9), strict=False):
        own = {H._hash(x) for x in H._text_names(b, i, len(blocks))}
        assert e == pytest.approx(crf.weights[f].sum() + crf.weights[[h for h in own if h in H._path_hashes(b.where, {})]].sum())
