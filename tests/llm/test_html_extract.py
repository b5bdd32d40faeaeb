import pytest

from tarnwright.llm import html_extract as op

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T &am</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href="/">Home</a></header>'
    '<nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy.</div><div id="cookie-notice">We use cookies.</div><aside>Side</aside>'
    "<article><h1>Title %d&amp;&copy;</h1><p><b>One  two\n%d.<br><p>Th<i>re</i>e &lt;x&gt;&nbsp; four %d.</p><form><input>Mail?</form><ul><li>i<li>j</ul></article>"
    '<section class="comments"><article class="comment"><p>Me too</p></article></section><footer>&copy; x</footer></body></html>'
)


def test_main_text():
    empty = {"root": [], "nested": {}, "main": "", "rank": 0, "fixed": []}
    want = "Title 1&© One two 1. Three <x> four 1. i j"
    assert op.main_text(PAGE % (1, 1, 1), empty) == want
    assert op.main_text((PAGE % (1, 1, 1)).replace("</body></html>", ""), empty) == want
    assert op.main_text("plain <i>t</i>ext", empty) == "plain text" and op.main_text("<p>", empty) == "" and op.main_text(None, empty) == ""
    assert op.main_text("<body><p>a &amp b</p><!-- open <p>c</p>", empty) == "a & b"


def test_template_of_a_host_without_names(spark):
    page = '<html><body><div class="x"><a href="/">Home</a> Welcome to the site</div><div class="y"><h2>Head %d</h2><p>Words %d and more words %d here</p></div><div class="z">Made by us</div></body></html>'
    rows = [(i, f"http://a.test/{i}", page % (i, i, i), 0) for i in range(8)] + [(9, None, None, 1), (10, "x", "", 1), (10, "x", "", 1), (None, "http://b.test", PAGE % (2, 2, 2), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    out = sorted((str(r.page_id), r.text, r.n_chars) for r in op.extract(pages).collect())
    want = [(str(i), f"Head {i} Words {i} and more words {i} here") for i in range(8)] + [("9", ""), ("10", ""), ("10", ""), ("None", "Title 2&© One two 2. Three <x> four 2. i j")]
    assert out == sorted((a, b, len(b)) for a, b in want)


def test_equivalence_classes(spark):
    rows = [(i, f"http://a.test/{i}", PAGE % (i, i, i)) for i in range(6)]
    import json

    found = {r.host: json.loads(r.template) for r in op.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found["a.test"]["main"] == "<article>" and found["a.test"]["rank"] == 3
    root = found["a.test"]["root"]
    assert root.index("<article>") < root.index("<h1>") < root.index("/<h1>") < root.index("/<article>")
    assert set(found) == {"a.test", op.ALL}


def test_empty(spark):
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", ["related-posts", "entry-footer", "post-footer", "post-navigation", "newsletter-signup", "article-comments", "comment-thread", "cookie-law-info", "article-sidebar", "discussion"])
def test_class_names_of_several_words_stand_apart(spark, name):
    body = "Main text of the page, long enough to be the article by far, with some more words in it."
    page = f"<body><article><p>{body}</p><div class='{name}'><article><p>Apart {name}</p></article></div></article></body>"
    other = f"<body><div class='post'><p>{body}</p><div class='{name}'>Apart</div></div></body>"
    rows = [(1, "http://a.com/1", page), (2, "http://b.com/1", other), (3, "http://c.com/1", page.replace(name, "share-price")), (4, "http://d.com/1", other.replace(name, "no-sidebar"))]
    out = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == out[2] == body and out[3] == f"{body} Apart share-price" and out[4] == f"{body} Apart"


def test_many_elements_take_linear_time():
    import time

    for page in (lambda n: "<article><p>text of one</p></article>" * n, lambda n: "<div>" * n + "</p>x" * n, lambda n: "<main>" + "<article>a b</article>" * n + "</main>"):
        took = []
        for n in (5_000, 20_000):
            began = time.perf_counter()
            op.main_text(page(n), {"main": "<article>", "rank": 3, "fixed": [], "root": [], "nested": {}})
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 1, took
