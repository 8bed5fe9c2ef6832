"""HTML blocks, the labeller's gradient, and extraction of layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.llm import extraction
from seasonframe.llm.extraction import DENSE, PATH, Tagger, extract, fit
from seasonframe.llm.html_blocks import blocks
from seasonframe.llm.html_examples import example_pages


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a&amp;b <b>c</b>\n d<br>e<p>f") == ["a&b c d e", "f"]
    assert texts("<div>x<p>y</div>z") == ["x", "y", "z"]
    assert texts("<script>if (a<b) {'</p>'}</script>k<style>p{}</style><!-- <p>no --><title>t</title>m") == ["km"]
    assert texts("<select><option>no</select><button>no</button>yes") == ["yes"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts('<p title="a>b">x</p><p a=\'>\'>y</p>') == ["x", "y"]
    assert texts("a < b & c &lt;d&gt; &#233; &nbsp; e") == ["a < b & c <d> é e"]
    assert texts("") == [] and texts("<p> </p>") == [] and texts("<") == ["<"] and texts("<!-- open") == [] and texts("<script>open") == []
    assert texts("</p></div>tail<p") == ["tail"]
    block = blocks('<div class="Main-Content x1"><nav id=top><a href=q>link</a> t</nav></div>')[0]
    assert block.path == (".content", ".main", ".top", ".x1", "div", "nav") and block.tag == "nav" and block.link_chars == 4


def test_a_head_ends_without_its_end_tag():
    story = ["h", "one", "two"]
    assert texts("<html><head><title>t</title><meta charset=x><link href=y><h1>h</h1><p>one<p>two") == story
    assert texts("<head><script>no</script><style>no</style>\n h <p>one</p><p>two</p>") == story
    assert texts("<head><template><p>no</p></template><noscript><link href=y></noscript><body><h1>h</h1><p>one<p>two") == story
    assert texts("<html><head><title>t</title></head><body><h1>h</h1><p>one<p>two</body></html>") == story
    left_out, whole = blocks("<html><head><title>t</title><p>one"), blocks("<html><head><title>t</title></head><body><p>one")
    assert left_out == whole


def test_text_of_formulas_fallbacks_and_plain_text_is_read():
    assert texts("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds</p>") == ["so E=m holds"]
    assert texts("<p>a</p><noscript><p>b</p></noscript><object data=x>c</object><p>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<xmp><b>&amp;</b></xmp>d") == ["a", "<b>&amp;</b>", "d"]
    assert texts("<button><xmp>no</xmp></button>yes") == ["yes"]


def test_deep_and_long_pages_end():
    assert len(texts("<div>" * 3000 + "x" + "</div>" * 3000)) == 1
    assert len(texts("<svg>" * 2000 + "<p>a</p>" * 2000)) == 0
    assert len(texts("<p>a</p>" * 5000)) == 5000
    texts("<a \"" * 2000)


def test_gradient():
    model, rng = Tagger(), np.random.default_rng(4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    lengths, x = np.array([3, 1, 4]), rng.random((4, 3, PATH + DENSE)) * (rng.random((4, 3, PATH + DENSE)) < 0.02)
    y = (rng.random((4, 3)) < 0.5).astype(np.float64)
    _, grad = model.gradients(x, lengths, y)
    for name in model.p:
        flat = model.p[name].ravel()
        at = int(np.abs(grad[name].ravel()).argmax())
        keep, eps = flat[at], 1e-2
        flat[at] = keep + eps
        up = model.gradients(x, lengths, y)[0]
        flat[at] = keep - eps
        down = model.gradients(x, lengths, y)[0]
        flat[at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(grad[name].ravel()[at], rel=0.03, abs=1e-4), name


@pytest.fixture(scope="module")
def model():
    return fit([[b for b in p if b.label >= 0] for p in map(blocks, example_pages([], n=500))])


def test_held_out_layouts(model):
    pages = [[b for b in p if b.label >= 0] for p in map(blocks, example_pages([], n=200, seed=123))]
    right = np.concatenate([(p >= 0.5) == np.array([b.label == 1 for b in page]) for page, p in zip(pages, model.probabilities(pages))])
    assert right.mean() > 0.96


def test_one_page_at_a_time_gives_the_same(model):
    pages = [blocks(p) for p in example_pages([], n=12, seed=5)]
    together, alone = model.probabilities(pages), [model.probabilities([p])[0] for p in pages]
    for a, b in zip(together, alone):
        assert np.allclose(a, b, atol=1e-4)


PAGE = """<html><head><title>T</title></head><body><header class="site-header"><a href=/>Site</a></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<main><article><h1>A &quot;title&quot;</h1><p>First paragraph of the story, with <a href=x>a link</a> inside.</p>
<div class="ad">Buy now</div><p>Second  paragraph,
on two lines.</p></article></main><aside class="sidebar"><h3>Related</h3><p>Another story that is not this one.</p></aside>
<section id="comments"><h2>2 comments</h2><div class="comment"><p>I liked reading this very much, thank you.</p></div></section>
<form><label>Name</label><input></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_extract(spark, monkeypatch):
    seen = []
    real = extraction.fit
    monkeypatch.setattr(extraction, "fit", lambda pages: seen.append(len(pages)) or real(pages))
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(30)
    rows = [(100000, "u", PAGE), (100001, None, None), (100002, "u", ""), (100003, "u", "<<<"), (None, "u", PAGE)]
    pages = given.unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = {r.page_id: r for r in extract(pages.withColumn("text", F.lit("clash")).withColumn("more", F.lit(1))).collect()}
    want = "A \"title\"\n\nFirst paragraph of the story, with a link inside.\n\nSecond paragraph, on two lines."
    assert out[100000].text == want and out[100000].n_chars == len(want) and out[None].text == want
    assert out[100001].text == out[100002].text == "" and out[100001].n_chars == 0 and out[100003].more == 1
    for r in out.values():
        if r.page_id is not None and r.page_id < 100000:
            assert "©" not in r.text and len(r.text) > 0
    assert seen
