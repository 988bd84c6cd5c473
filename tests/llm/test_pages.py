import html
import random
import re
import time

import numpy as np
import pytest

from siltstream.llm import pagecrf


@pytest.fixture(scope="module")
def field():
    return pagecrf.trained()


def test_held_out_pages_are_labelled_right(field):
    right = total = whole = 0
    pages = pagecrf.labelled_pages(150, seed=99)
    for page, main in pages:
        found = pagecrf.blocks(page)
        labels = pagecrf.labels_of(found, main)
        assert labels.sum() == len(main)
        got = np.array(field.decode(found))
        right += int((got == labels).sum())
        total += len(labels)
        whole += bool((got == labels).all())
    assert right / total > 0.99 and whole / len(pages) > 0.95


def test_viterbi_finds_the_best_labels():
    r = random.Random(1)
    for _ in range(50):
        names = ["a", "b", "c"]
        f = pagecrf.ChainField({n: (r.gauss(0, 1), r.gauss(0, 1)) for n in names}, np.array([[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]))
        found = [pagecrf.Block("x", tuple(r.sample(names, r.randrange(4)))) for _ in range(r.randrange(1, 7))]

        def worth(labels):
            s = sum(f.weights[n][y] for b, y in zip(found, labels, strict=True) for n in b.features)
            return s + sum(f.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(worth([int(x) for x in f"{k:0{len(found)}b}"]) for k in range(1 << len(found)))
        assert abs(worth([int(x) for x in f.decode(found)]) - best) < 1e-9


def test_training_follows_the_gradient():
    """A field trained on a chain where labels alternate learns that they do."""
    pages = [([pagecrf.Block("x", ("same",))] * 6, np.array([0, 1] * 3)) for _ in range(20)]
    f = pagecrf.ChainField.train(pages)
    assert f.moves[0, 1] > f.moves[0, 0] and f.moves[1, 0] > f.moves[1, 1]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a<p>b", ["a", "b"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("<p>x <b>y</b>\n z<br>w</p>", ["x y z w"]),
        ("a<!-- no <p>b</p> -->c", ["ac"]),
        ("<!-->a<!-- never closed", ["a"]),
        ("<script>if (a</b) '<p>'</script>t<style>p{}</style>", ["t"]),
        ("<SCRIPT>x</SCRIPT >y", ["y"]),
        ("<p title='a>b'>c</p>", ["c"]),
        ("<p don't>x's</p>", ["x's"]),
        ("1 < 2 &amp; 3 &lt; 4 &#233;&nbsp;x", ["1 < 2 & 3 < 4 é x"]),
        ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("</p></div>a", ["a"]),
        ("<title>t</title><textarea>u</textarea>", []),
        ("<p>un<b>bro</b>ken</p>", ["unbroken"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in pagecrf.blocks(page)] == texts


@pytest.mark.parametrize("piece", ["<script ", "</p x ", "<a x ", "<b>x", "<div>x", "<p>x<i>", "<b><i></b>", "<li>x<ul>", "<a x=\"> '", "&amp "])
def test_the_reader_takes_time_in_proportion(piece):
    began = time.perf_counter()
    pagecrf.blocks(piece * (400_000 // len(piece)))
    assert time.perf_counter() - began < 15  # seconds; a quadratic reader would take many minutes


#: Pages by other hands: layouts that the grammar doesn't write, with the article's text.
FOREIGN = [
    (
        """<html><head><title>t</title></head><body id="top"><div id="page"><header id="masthead"><a href="/">Site name</a><nav class="main-navigation"><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav></header>
        <div class="site-content"><main id="primary"><article id="post-12" class="post type-post"><header class="entry-header"><h1 class="entry-title">A walk by the sea</h1></header>
        <div class="entry-content"><p>We set out early, while the harbour was still dark.</p><p>By noon the tide had turned, and we ate on the rocks.</p><figure><img src="x.jpg"><figcaption>The rocks at noon.</figcaption></figure></div></article>
        <section id="comments" class="comments-area"><h2>2 thoughts</h2><ol><li class="comment"><p>Lovely, thank you for this.</p></li></ol><form><label>Name</label><input></form></section></main>
        <aside id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/x">Another walk</a></li></ul></aside></div><footer class="site-footer">&copy; 2020 Site name</footer></div></body></html>""",
        "A walk by the sea We set out early, while the harbour was still dark. By noon the tide had turned, and we ate on the rocks. The rocks at noon.",
    ),
    (
        """<body><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><div class="topnav"><a href=1>News</a> <a href=2>Sport</a></div><div role="main"><h1>Council votes on bridge</h1>
        <p>The council voted on Monday to repair the old bridge.</p><div class="advert"><p>Buy one, get one free, today only.</p></div><p>Work will begin in spring &amp; last a year.</p><blockquote><p>It was high time, said the mayor.</p></blockquote></div>
        <div class="related"><h3>More news</h3><p><a href=3>Floods in the north</a></p></div><div id="footer"><p>All rights reserved.</p></div></body>""",
        "Council votes on bridge The council voted on Monday to repair the old bridge. Work will begin in spring & last a year. It was high time, said the mayor.",
    ),
    (
        """<html><body><nav role="navigation"><ul><li><a href="#">Docs</a></li></ul></nav><div class="newsletter"><p>Sign up for our newsletter.</p><form><input><button>Send</button></form></div><article><h1>Install</h1><p>Run the program once.</p><pre>make all</pre>
        <ul><li>First step.</li><li>Second step.</li></ul><table><tr><td>Size</td><td>Ten</td></tr></table></article><div class="comments"><p>Did not work for me at all, sadly.</p></div><footer><a href="#">Imprint</a></footer></body></html>""",
        "Install Run the program once. make all First step. Second step. Size Ten",
    ),
]


@pytest.mark.parametrize(("page", "text"), FOREIGN)
def test_foreign_layouts(field, page, text):
    assert pagecrf.main_text(field, page) == text


def test_tables_pages_give_their_articles(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").join(pagecrf.op10_html_extraction(spark, sf_dir), ["page_id", "url"]).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text)


def test_odd_and_empty_tables(spark, field):
    odd = [None, "", " ", "<", "<p", "&", "<article>" * 300 + "x", "<p>" + "word " * 50_000, "\x00", "<a href='" * 50, "<" * 3000]
    rows = [(i, None if i % 2 else "u", h) for i, h in enumerate(odd)] + [(None, "u", "<main><p>m</p></main>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = pagecrf.extract_pages(df, field).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (0, 1, 2)} == {""} and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id is None] == ["m", "m"]
    assert pagecrf.extract_pages(df.limit(0), field).count() == 0
