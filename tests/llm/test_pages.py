import random

import numpy as np
import pytest

from dataprobe.llm import pages
from dataprobe.llm.boosting import BoostedTrees


@pytest.fixture(scope="module")
def model():
    return pages.page_model()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now, only today.</div>
<article><h1>The  title &amp; more</h1><p><b>First line of the text, with words.<br><p>Second&nbsp;paragraph &lt;tag&gt; of\n the text, long enough to read.</p>
<script>track("x")</script><p title="a>b">Third &eacute;t&#233; paragraph, again with some words.</p></article>
<footer>&copy; nobody</footer></body></html>"""


def test_page_of_the_contract(model):
    assert pages.extract_texts([PAGE], model) == [
        "The title & more\n\nFirst line of the text, with words.\n\nSecond paragraph <tag> of the text, long enough to read.\n\n"
        "Third été paragraph, again with some words."]


@pytest.mark.parametrize("source", [
    "", " ", "plain text only", "<", "<p", "</p>", "<p>a</div></p></p>", "<script>never closed", "<!-- open", "<a href='x>y</a>", "<p>&#0;&#xZZ;&bogus;&amp",
    "<table><tr><td>a<td>b<tr><td>c</table>", "<div " * 50, "<b>" * 3000 + "deep" + "</b>" * 3000, "<p a=\"<b>\">x</p>", "<![CDATA[x]]>y", "İ<script>x</script>z"])
def test_odd_pages_do_not_stop_the_others(model, source):
    out = pages.extract_texts([source, PAGE, source], model)
    assert out[1].startswith("The title") and out[0] == out[2]


def test_structure():
    page = pages.Page("<ul><li>a<li>b</ul><p>c<div>d</div>e")
    names = [(p, d) for p, d in zip(page.parent, page.depth)]
    assert names == [(-1, 0), (0, 1), (1, 2), (1, 2), (0, 1), (0, 1)]
    assert page.end == [6, 4, 3, 4, 5, 6]
    assert len({b for _, b, _ in page.runs}) == 5


def test_held_out_pages(model):
    """Made-up pages of other mark-up and words than those the model was fitted on."""
    r = random.Random(12345)
    sources = [pages.training_page(r) for _ in range(200)]
    exact = 0
    for source, found in zip(sources, pages.extract_texts(sources, model)):
        exact += found == pages.page_text(pages.Page(source), pages.node_labels(source))
    assert exact >= 0.95 * len(sources)


def test_choices_do_not_contradict():
    page = pages.Page("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    n = len(page.tag)
    yes, no = np.full(n, np.log(.9)), np.full(n, np.log(.1))
    lone = no.copy(), yes.copy()
    lone[0][2], lone[1][2] = np.log(.55), np.log(.45)         # a weak yes in a subtree that is clearly to be dropped
    assert not pages.decide(page, *lone).any()
    part = no.copy(), yes.copy()
    for v in (1, 2, 3):
        part[0][v], part[1][v] = yes[v], no[v]
    assert pages.decide(page, *part).tolist() == [False, True, True, True, False, False]


def test_trees_learn():
    r = np.random.default_rng(3)
    x = r.uniform(size=(4000, 5))
    y = ((x[:, 0] > .5) ^ (x[:, 1] > .3)).astype(float)
    trees = BoostedTrees.fit(x[:3000], y[:3000], np.ones(3000), trees=20)
    assert ((trees.predict(x[3000:]) > .5) == y[3000:]).mean() > .97


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (3, "u", "", "old"), (3, "u", "", "old")],
                               "page_id long, url string, html string, Text string")
    out = {r.page_id: (r.text, r.n_chars) for r in pages.extract_main_text(df).collect()}
    assert out[1][0].startswith("The title") and out[1][1] == len(out[1][0]) and out[2] == out[3] == ("", 0)
    assert pages.extract_main_text(df).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert pages.extract_main_text(df.limit(0)).count() == 0
