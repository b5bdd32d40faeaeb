"""Main text of pages: whole pages, copies, parts and templates."""

import pytest

from tarnwright.llm import html_extract

NONE = {"root": [], "nested": {}, "main": "", "rank": 0, "encloses": []}


@pytest.mark.parametrize("empty", ["<svg/>", '<svg viewBox="0 0 1 1" />', "<math/>"])
def test_self_closed_svg_cuts_nothing(empty):
    assert html_extract.main_text(f"<article><p>one {empty} two</p><p>three</p></article>", NONE) == "one two three"
    assert html_extract.main_text(f"<article><p>one {empty} two</p><svg><text>drawn</text></svg> three</article>", NONE) == "one two three"


def texts(spark, rows):
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    return {r.page_id: r.text for r in out}


def test_copied_pages_keep_their_text(spark):
    page = "<html><body><div><p>{} first part of it.</p><p>{} second part of it.</p></div></body></html>"
    rows = [(i, f"http://same.org/{i}", page.format("Same", "Same")) for i in range(5)]
    rows += [(10 + i, f"http://most.org/{i}", page.format(*(["Copied"] * 2 if i < 7 else [f"Own{i}"] * 2))) for i in range(10)]
    rows += [(30 + i, f"http://near.org/{i}", page.format(*(["Near"] * 2 if i < 7 else [f"Other{i}"] * 2)).replace("<div>", f"<!--{i}--><div>")) for i in range(10)]
    out = texts(spark, rows)
    for i, _, html in rows:
        a, b = html.split("<p>")[1:]
        assert out[i] == f"{a.split('</p>')[0]} {b.split('</p>')[0]}"


def test_parts_side_by_side_are_joined(spark):
    two = '<body><div class="content"><p>one {0}</p></div><div class="ad">buy</div><div class="content"><p>two {0}</p></div></body>'
    parts = "<body><main><article><p>one {0}</p></article><aside>buy</aside><article class=more><p>two {0}</p></article><article><a href=x>see also</a></article></main></body>"
    assert html_extract.main_text(two.format(7), NONE) == "one 7 two 7"
    assert html_extract.main_text(parts.format(7), NONE) == "one 7 two 7"
    rows = [(10 * k + i, f"http://h{k}.org/{i}", page.format(f"w{i}")) for k, page in enumerate((two, parts)) for i in range(6)]
    out = texts(spark, rows)
    assert all(out[i] == f"one w{i % 10} two w{i % 10}" for i, *_ in rows)


def test_template_decides(spark):
    inside = "<body><article><p>text {0}</p><p>Support our paper.</p><div class=box><b>Read more</b></div></article></body>"
    form = '<body><form id=f><div class="nav"><a href=x>home</a></div><div><p>a whole text {0}</p></div></form></body>'
    names = '<body><div class="content"><p>Welcome to the site of all sites.</p></div><div class="x"><p>text {0}</p></div></body>'
    rows = [(10 * k + i, f"http://t{k}.org/{i}", page.format(f"w{i}")) for k, page in enumerate((inside, form, names)) for i in range(6)]
    rows[5] = (5, "http://t0.org/5", "<body><article><p>text w5</p><p>Support our paper.</p></article></body>")
    out = texts(spark, rows)
    assert [out[i] for i in range(6)] == [f"text w{i}" for i in range(6)]
    assert [out[10 + i] for i in range(6)] == [f"a whole text w{i}" for i in range(6)]
    assert [out[20 + i] for i in range(6)] == [f"text w{i}" for i in range(6)]


def test_stray_quotes_hide_nothing():
    for page, text in {
        '<p>one <a title="x>two</a> three</p>': "one two three",
        '<p>one <a title="x>two</a> three</p><p class="y">four</p>': "one two three four",
        "<p class=it's>five</p><p class='a'>six</p>": "five six",
        '<p data-x="<b>no</b>" title=\'a > b\'>seven</p>': "seven",
        '<p>eight</p><a href="nine': "eight",
        '<p a="b"c="d">ten</p>': "ten",
        "a < b and c <3 d": "a < b and c <3 d",
    }.items():
        assert html_extract.main_text(page, NONE) == text, page
    assert html_extract.main_text("<p>x</p>" + '<a b="c" ' * 3000, NONE) == "x"


def test_what_stands_apart_by_name_and_what_does_not():
    page = "<article><p>a</p>{}<p>z</p></article>"
    for part in ('<p class="share-price">up</p>', '<div class="comment-policy">up</div>', '<p class="advert-history">up</p>', '<p class="no-sidebar">up</p>', '<p hidden="false">up</p>', '<p class="hidden visible">up</p>'):
        assert html_extract.main_text(page.format(part), NONE) == "a up z", part
    for part in ('<div class="share-buttons">up</div>', '<section class="comments-section">up</section>', '<div id="cookie-notice">up</div>', '<div class="x site-footer">up</div>', "<p hidden>up</p>", '<p style="display: none">up</p>', '<div role="navigation">up</div>'):
        assert html_extract.main_text(page.format(part), NONE) == "a z", part


def test_main_round_articles_keeps_its_own_text():
    assert html_extract.main_text("<main><p>intro</p><article>text</article><p>end</p><nav>menu</nav></main>", NONE) == "intro text end"
    assert html_extract.main_text("<main><h2><a href=x>links</a></h2><article>text</article></main>", NONE) == "text"


def test_a_host_named_as_a_star(spark):
    rows = [(i, f"http://*/{i}", f"<body><div><p>Star {i} text</p></div><div>Always the same words</div></body>") for i in range(6)]
    rows += [(10 + i, f"http://h{i}.org/", f"<body><article>other {i}</article></body>") for i in range(6)]
    out = texts(spark, rows)
    assert [out[i] for i in range(6)] == [f"Star {i} text" for i in range(6)] and [out[10 + i] for i in range(6)] == [f"other {i}" for i in range(6)]


def test_repeated_blocks_in_slots_of_hosts_without_names(spark):
    """Elements x, y and z tell nothing; the template has the menu, the notice and the line after the text."""
    page = "<html><body><x><a href=/>Home</a> All of the news</x><y><z>Head {0}</z>{1}<z>Written by our editors.</z></y><x>Imprint and terms</x></body></html>"
    rows = [(i, f"http://plain.org/{i}", page.format(i, "".join(f"<z>Block {i}.{k} of the text</z>" for k in range(1 + i % 4)))) for i in range(12)]
    out = texts(spark, rows)
    for i in range(12):
        assert out[i] == " ".join([f"Head {i}", *[f"Block {i}.{k} of the text" for k in range(1 + i % 4)]])
        assert html_extract.main_text(rows[i][2], NONE) != out[i]


def test_roles_of_equal_blocks_on_pages_without_names(spark):
    """With every sectioning element a div and every class word neutral, pages give the text that they give with names."""
    import re

    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()]
    neutral = [(i, url, re.sub(r"<(/?)(?:article|main|nav|aside|footer|header|section)\b", r"<\1div", html).replace('class="ad"', 'class="x"')) for i, url, html in pages]
    named, found = texts(spark, pages), texts(spark, neutral)
    assert all(html_extract.main_text(html, NONE) == named[i] for i, _, html in pages)
    assert sum(found[i] == named[i] for i in named) >= 0.95 * len(named)
    assert sum(html_extract.main_text(html, NONE) == named[i] for i, _, html in neutral) == 0


def test_roles_tell_constant_blocks_only(spark):
    """Blocks whose number varies are no roles: none is taken for the whole text; a page of other blocks keeps all its text."""
    page = "<body><div><a href=x>home</a> Of today</div><div>{}</div></body>"
    rows = [(i, f"http://v.org/{i}", page.format("".join(f"<div>part {i}.{k} of it</div>" for k in range(1 + i % 3)))) for i in range(12)]
    rows.append((20, "http://v.org/20", "<body><div>only 20</div></body>"))
    out = texts(spark, rows)
    for i in range(12):
        assert out[i] == " ".join(f"part {i}.{k} of it" for k in range(1 + i % 3))
    assert out[20] == "only 20"


def test_time_is_linear_in_nested_and_equal_blocks(spark):
    import time

    def seconds(n):
        nested = "<body>" + "<div class=ad>" * n + "x" + "</div>" * n + "<div>" * n + "deep" + "</div>" * n
        equal = "<body>" + "<div>always</div>" * n + "</body>"
        at = time.process_time()
        for p in (nested, equal):
            html_extract.tokens(p), html_extract.main_text(p, NONE)
        return time.process_time() - at

    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)
    out = texts(spark, [(i, "http://d.org/", "<body>" + "<div>same</div>" * 10_000 + f"<div>own {i}</div></body>") for i in range(5)])
    assert all(t.endswith(f"own {i}") for i, t in out.items())


def test_templates_match_a_plain_deduction(spark):
    """Exact occurrence vectors, held in a dictionary, give the templates that Spark's sums of hashes give."""
    import json

    import pandas as pd

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "url", "html").collect()
    by_host: dict[str, set[str]] = {}
    for r in rows:
        by_host.setdefault(r.url.split("://")[1].split("/")[0].split("?")[0].lower(), set()).add(r.html)
    found = {r.host: json.loads(r.template) for r in html_extract.templates(pages).collect()}
    hosts = {h for h, p in by_host.items() if len(p) >= html_extract.MIN_PAGES}
    assert set(found) == hosts | {html_extract.ALL} and len(hosts) > 5
    for host in hosts:
        contents = sorted(by_host[host])
        seen = [html_extract.tokens(p) for p in contents]
        vectors: dict[tuple, int] = {}
        table = []
        for token in {t for x in seen for t in x}:
            on = [x[token] for x in seen if token in x]
            vector = tuple(x[token][0] if token in x else 0 for x in seen)
            number = vectors.setdefault(vector, len(vectors))
            table.append((token, len(on), sum(vector), *[sum(x[k] for x in on) for k in (1, 2, 3, 4)], number, 0))
        plain = html_extract.deduce(pd.DataFrame(table, columns=["token", "pages", "total", "first", "chars", "links", "encloses", "v1", "v2"]), len(contents))
        assert plain == found[host]
        once = {t for t in {t for x in seen for t in x} if all(t in x and x[t][0] == 1 for x in seen) and not t.startswith("#")}
        assert {t for t in found[host]["root"] if not t.startswith("#")} == once


def test_very_long_pages(spark):
    long = "<body><nav>" + "<a href=x>menu</a>" * 20_000 + "</nav><article>" + "<p>word &amp; word</p>" * 50_000 + "</article></body>"
    out = texts(spark, [(1, "http://l.org/", long), (2, "http://l.org/2", "<body>" + "<div>" * 5_000 + "deep" + "</div>" * 5_000)])
    assert out[1] == "word & word " * 49_999 + "word & word" and out[2] == "deep"
