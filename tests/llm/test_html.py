"""The block labeller: parsing, gradient, layouts that it has not seen, and the pages of a table."""

import html
import random
import re
import time

import numpy as np
import pytest

from quillstone.llm import html_blocks as blocks
from quillstone.llm import html_extraction, html_training

SF = "/root/testdata/sf0.01"


def plain(page):
    """The text between the article tags of the tables' layout."""
    inner = re.sub(r"</?(?:h1|p)>", "\n", page[page.index("<article>") + 9 : page.index("</article>")])
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in inner.split("\n"))
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def trained(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    return html_extraction.fit(pages, "html", 150, 600)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = html_extraction.extract(pages.withColumn("n_chars", pages.url)).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) and r.url for r in got)


def test_layouts_not_seen(trained):
    rng = random.Random(11)
    main = ["The river rose in the night, and by morning the lower road was gone.", "Nobody had seen it so high.", "They went on foot."]
    other = ["Home", "Contact us", "All rights reserved", "Sign up for our newsletter today"]
    drawn = [html_training.layout(rng, html_training.words_of(main), html_training.words_of(other)) for _ in range(200)]
    wrong = sum(int(((trained.run(blocks.Sequences([p]))[0] > 0) != np.array(y)).sum()) for p, y in drawn if p)
    assert wrong / sum(len(y) for _, y in drawn) < 0.03


def test_one_page_with_everything(trained):
    body = "".join(f"<p>Paragraph {w} of the story, told at some length so that it reads like one.</p>" for w in ("one", "two", "three"))
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>A &amp; B</h1>{body}<script>var x = '</p>';</script><div class=ad>Buy now</div></article>"
        "<aside class=sidebar><p>Most read</p></aside><form><label>Name</label><button>Send</button></form>"
        "<div class='comments'><div class='comment'><p>I liked this story very much.</p></div></div><footer>&copy; us</footer>"
    )
    want = ["A & B"] + re.findall(r"<p>(Paragraph.*?)</p>", body)
    assert trained.main_texts([blocks.leaves(page)]) == ["\n".join(want)]


def test_leaves():
    def of(page):
        return [(leaf.node.element if leaf.node else "", leaf.text) for leaf in blocks.leaves(page)]

    assert of("") == of("<!-- a <p>b</p>") == of("<script>x") == []
    assert of("a  <b>b</b>\n c") == [("", "a b c")]
    assert of("<p>one<p>two<br>three</p>four") == [("p", "one"), ("p", "two three"), ("", "four")]
    assert of("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]
    assert of("<div class='x Main-2'>&lt;p&gt; &amp &#233;&nbsp;1 < 2</div>") == [("div ~x ~main ~2", "<p> & é 1 < 2")]
    assert of("<p>a</div></p><p><b>c<p>d</b>e") == [("p", "a"), ("p", "c"), ("p", "d e")] or of("<p>a</div></p>") == [("p", "a")]
    assert of("<p hidden style='display: none'>a") == [("p ~hidden ~hidden", "a")]
    # what has no text does not hold a block's place
    assert of("<nav>x</nav><p><img>a<div><br>b</div>&nbsp; <wbr><h2> <img> c</h2>") == [("nav", "x"), ("p", "a"), ("div", "b"), ("h2", "c")]
    assert of("<p>a<textarea>b <p>c</textarea>d<button>e</button><select><option>f</select>g") == [("p", "a d"), ("p", "g")] or of("<p>a<textarea>b</textarea>d") == [("p", "ad")]
    assert of("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f") == [("td", "a"), ("td", "b"), ("td", "c"), ("td", "d"), ("td", "e"), ("", "f")]
    assert blocks.leaves("<div><b><p>x</b>y</p>")[0].path == ["div", "p"]


def test_deep_and_long_pages(trained):
    began = time.process_time()
    deep = blocks.leaves("<div>x" * 50_000)
    assert len(deep) == 50_000 and len(deep[-1].path) == 50_000
    assert trained.main_texts([deep, blocks.leaves("<ul>" + "<li>item <b>of</b> a list" * 50_000)])[1].count("\n") in range(50_000)
    assert len(blocks.leaves("<b><i><a>" * 30_000 + "x")) == len(blocks.leaves("</p>x" * 30_000)) // 30_000 == 1
    assert time.process_time() - began < 40


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    model = blocks.Labeller()
    model.weights = [w.astype(np.float64) for w in model.weights]
    pages = [blocks.leaves(p) for p in ("<p>a<p>b c<div>d", "<ul><li>x</ul>", "<h1>h</h1><p>a b<p>c<p>d e f g")]
    sequences = blocks.Sequences(pages)
    labels = rng.integers(0, 2, sequences.n).astype(np.float64)

    def loss():
        p = blocks.sigmoid(model.run(sequences)[0])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for weight, slope in zip(model.weights, model.gradient(sequences, labels)):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in weight.shape)
            kept, step = weight[at], 1e-4
            weight[at] = kept + step
            high = loss()
            weight[at] = kept - step
            low = loss()
            weight[at] = kept
            assert abs((high - low) / (2 * step) - slope[at]) < 2e-3 * max(1, abs(slope[at]))


def test_scores_do_not_depend_on_other_pages(trained):
    pages = [blocks.leaves(p) for p in ("<p>a<p>b c<div>d", "", "<ul><li>x</ul>", "<h1>h</h1><p>a b<p>c")]
    together = trained.run(blocks.Sequences(pages))[0]
    alone = np.concatenate([trained.run(blocks.Sequences([p]))[0] for p in pages if p])
    assert np.allclose(together, alone, atol=1e-4)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<article><p>Some words of a story that goes on for a while.</p></article>"), (2, "u", "   ")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extraction.extract(pages, drawn=50).collect()
    assert len(got) == 4
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id != 2)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(empty, drawn=5).count() == 0
