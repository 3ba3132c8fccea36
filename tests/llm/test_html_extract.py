"""Main text of pages, and minimum cuts against all labellings."""

import itertools
import random

from harrow.llm import html_extract

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p {color: red}</style><script>var a = "<p>no</p>";</script></head>
<body><header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First   paragraph of <b>the</b> article,
with a line break &#8212; and more text so that it is long enough to be read.</p><!-- <p>hidden</p> -->
<p>Second paragraph, which goes on about the same matter for a while.</p><div class="ad-banner">Buy now</div><pre>x  &lt; y</pre></article>
<aside>Popular posts</aside><div class="comments"><p>Nice article, thank you for writing it all down so carefully.</p></div>
<form>Your mail <input name="a"></form><footer>Copyright</footer></body></html>"""


def test_article():
    assert html_extract.extract(PAGE) == "A & B\nFirst paragraph of the article, with a line break — and more text so that it is long enough to be read.\nSecond paragraph, which goes on about the same matter for a while.\nx < y"


def test_minimum_cut():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 8)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randrange(8))]
        edges = [e for e in edges if e[0] != e[1]]

        def price(labels, cost=cost, edges=edges):
            return sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(cost, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        got = html_extract.minimum_cut(cost, edges)
        assert abs(price(got) - min(map(price, itertools.product([False, True], repeat=n)))) < 1e-6


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = html_extract.main_text(pages).collect()
    assert len(got) == pages.count()
    assert all(r.n_chars == len(r.text) and "<script" not in r.text for r in got)
    assert sum(r.n_chars > 0 for r in got) > 0.9 * len(got)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "plain text without any markup, long enough to be a paragraph of its own."), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<div " + "a" * 50_000), (6, "u", "<!-- never closed <p>x</p>"), (7, "u", "&lt;" * 20_000), (2, "u", "")]
    got = html_extract.main_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2, 6)] == [""] * 4
    assert next(r.text for r in got if r.page_id is None).startswith("plain text")


BODY = "<article><p>First paragraph, which is long enough to be read as text by itself.</p><p>Second one, that goes on about the matter.</p></article>"
TEXT = "First paragraph, which is long enough to be read as text by itself.\nSecond one, that goes on about the matter."


def test_missing_end_tags():
    assert html_extract.extract(f"<datalist><option value=a><option value=b></datalist>{BODY}") == TEXT
    for tag in ("iframe", "object", "canvas", "video", "audio", "select", "svg", "noscript", "template", "noframes", "math"):
        assert html_extract.extract(f"<div><{tag}></div>{BODY}") == TEXT, tag
    for tag in ("script", "style", "textarea", "title"):
        assert html_extract.extract(f"{BODY}<{tag}><p>No text of the page, though it is long enough to be some.</p>") == TEXT
    assert html_extract.extract(BODY + "<iframe>" * 20_000) == TEXT


def test_inline_elements_stay():
    page = "<article><p>The sum <math><mi>a</mi>+<mi>b</mi></math> and <object>the text of an object</object> stay in this paragraph.</p></article>"
    assert html_extract.extract(page) == "The sum a+b and the text of an object stay in this paragraph."


LONG = "<p>" + "A sentence of the article that goes on for a while, so that it is read as such. " * 4 + "</p>"


def test_class_words_do_not_rule_articles_out():
    article = f"<article><div class='entry-header'><h1>Its title</h1></div>{LONG}<p>Short end.</p></article>"
    want = html_extract.extract(article)
    assert want.startswith("Its title\nA sentence") and want.endswith("Short end.")
    around = "<nav><a href=/>Home</a></nav>{}<div class='sidebar'><p>Popular posts of this week, listed for you here.</p></div><footer>Copyright</footer>"
    for page in (
        article.replace("<article>", "<article class='post category-social'>"),
        f"<div class='layout has-sidebar'>{article}</div>",
        f"<form id='aspnetForm'>{article}</form>",
        article.replace("<article>", "<article data-id='ad-17'>"),
        article.replace("<article>", "<article title='x id=ad-17'>"),
    ):
        assert html_extract.extract(page) == want, page
        assert html_extract.extract(around.format(page)) == want, page
    whole = "<form id='aspnetForm'><div class='layout has-sidebar'>" + around.format(article) + "</div></form>"
    assert html_extract.extract(whole) == want


def test_form_around_a_page_without_article():
    page = f"<body><form id='aspnetForm'><div class='menu'><a href=/>Home</a></div><h1>Title</h1>{LONG * 2}<div class='comments'><p>Nice text, thank you for writing it.</p></div></form></body>"
    got = html_extract.extract(page)
    assert "A sentence of" in got and "Title" in got and "Nice text" not in got and "Home" not in got


def test_boilerplate_in_articles_goes():
    ad = "<div class='advert'><p>" + "Buy this product now, since it is the best that there is of all. " * 4 + "</p></div>"
    assert "Buy this" not in html_extract.extract(f"<article>{LONG * 3}{ad}{LONG}</article>")
    assert html_extract.extract(f"<div hidden>{LONG}</div><div style='display: none'>{LONG}</div><aside>{LONG}</aside>") == ""


def test_names_of_states_do_not_count():
    for name in ("content no-comments", "post has-sidebar", "with-ads story", "no_share hide-menu"):
        assert html_extract.extract(f"<div class='{name}'>{LONG * 2}</div>").startswith("A sentence of the article"), name


def test_the_cut_changes_labels():
    """Blocks that the classifier alone calls wrongly are set right by their neighbours, either way."""

    def turned(page):
        blocks = html_extract.blocks_of(page)
        kept = html_extract.extract(page).split("\n")
        return [(b.text[:20], html_extract.evidence(b) > 0, b.text in kept) for b in blocks if (html_extract.evidence(b) > 0) != (b.text in kept)]

    inside = f"<div>{LONG}{LONG}<ul><li>a short item</li></ul>{LONG}{LONG}</div>"
    assert ("a short item", False, True) in turned(inside)
    menu = "".join(f"<li><a href='/{i}'>An item of the menu {i}</a></li>" for i in range(12))
    between = f"<body><ul>{menu}<li>Just these words.</li>{menu}</ul><div>{LONG}{LONG}</div></body>"
    assert "Just these words." not in html_extract.extract(between) and "A sentence" in html_extract.extract(between)
