"""Main texts against a plain reading of marked articles, on layouts that no training page has, and on broken markup."""

import html as entities
import re
import time

import pytest

from hazeline.llm import html

SF = "/root/testdata/sf0.001"
SAY = "The committee met on Tuesday to discuss the budget for the coming year, and members agreed on most points."
_BREAK = re.compile(r"</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|blockquote)\b[^>]*>")


def article(page):
    """Blocks of the article element, read with plain patterns."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = _BREAK.split(m[1]) if m else []
    return "\n\n".join(t for t in (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks) if t)


@pytest.fixture(scope="module")
def built_in():
    return html.train([])


def test_articles_of_the_table(spark, built_in):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    for model in (built_in, html.fitted(pages, sample=40)):
        got = {r.page_id: r.text for r in html.main_texts(pages, model).collect()}
        assert got == want


@pytest.mark.parametrize("page", [
    '<body><form id="aspnetForm"><nav><a href=1>Home</a></nav><article>{}</article><input></form></body>',
    '<body><form><div class="menu"><a href=1>Home</a></div><div class="content">{}<p>{say}</p><p>{say}</p></div></form></body>',
    "<body><article><header><p>By Ann</p></header>{}<aside><p>{say}</p></aside><footer><p>Filed under x</p></footer></article></body>",
    '<body><div y="1" class="menu"><ul><li><a href=1>Home</a></li></ul></div><article y="0">{}</article></body>',
    '<body><div id="cookie-banner"><p>{say}</p></div><main>{}</main><div class="comments-area"><article><p>{say}</p></article></div></body>',
    '<body><div class="nav-wrap"><ul><li><a href=1>A</a></li><li><a href=2>B</a></li></ul></div><div class="story">{}</div><div class="related-posts"><p>{say}</p></div><form><p>{say}</p></form></body>',
])
def test_layouts_that_training_has_not(built_in, page):
    inner = f"<p>{SAY}</p><p>Second. {SAY}</p>"
    text = html.main_text(page.replace("{}", inner).replace("{say}", SAY), built_in)
    tail = [SAY, SAY] if "aspnet" not in page and "<form><div" in page else []
    assert text.split("\n\n") == [SAY, "Second. " + SAY, *tail]


def test_a_page_cannot_turn_labels_round():
    poison = ['<body><div y="1" class="menu"><ul><li><a href=1>Home</a></li></ul></div><article y="0"><p>' + SAY + "</p></article></body>"] * 50
    assert html.main_text(f"<body><ul class=menu><li><a href=1>Home</a></li></ul><article><p>{SAY}</p></article></body>", html.train(poison)) == SAY
    assert html.structural(html.parse(poison[0]))[-1] == 1


def test_nothing_else_is_dropped(built_in):
    page = f"<article><p>Let <math><mi>x</mi></math> be <object>it</object> or <canvas>so</canvas>. {SAY}</p><p>a<script>b</script>c &eacute;&#33;</p><p>{SAY}"
    assert html.main_text(page, built_in) == f"Let x be it or so. {SAY}\n\nac é!\n\n{SAY}"


@pytest.mark.parametrize("bit", ["<!", "<i>", "<div>", "<p>", '<a "', "</b>", "<i></b>", "<table>", "<section><table>", "&", "<", "<td>", "<li>"])
def test_broken_markup_takes_linear_time(built_in, bit):
    t = time.perf_counter()
    html.main_text(f"<article><p>{SAY}</p>" + bit * 20_000 + "</section>" * 20_000 + "</i>" * 20_000, built_in)
    assert time.perf_counter() - t < 5


def test_long_pages_and_repeated_rows(spark, built_in):
    long = "<article>" + f"<p>{SAY}</p>" * 20_000 + "</article>"
    d = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, f"<article><p>{SAY}")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS page", "3 AS n_chars")
    got = [(r.page_id, r.n_chars) for r in html.main_texts(d, built_in).collect()]
    n = 20_000 * (len(SAY) + 2) - 2
    assert sorted(got, key=str) == sorted([(1, n), (1, n), (None, len(SAY))], key=str)


def without_headings(inner):
    return re.sub(r"<h([1-6])>.*?</h\1>", "", inner, flags=re.S)


def one_paragraph(inner):
    """The first paragraph alone; what stands before it in a broken one goes."""
    m = re.search(r"<p>.*?(?=<p>|</p>|$)", without_headings(inner).split("<br>")[-1], re.S)
    return m[0] + "</p>" if m else inner


@pytest.mark.parametrize("element", ["article", "div", "section", "main"])
@pytest.mark.parametrize("change", [lambda x: x, without_headings, one_paragraph])
def test_no_article_vanishes(spark, built_in, change, element):
    """All pages of the table, also with less in the article and with another element around it."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html IS NOT NULL").collect()]
    for page in pages:
        page = re.sub(r"<article>(.*?)</article>", lambda m: f"<article>{change(m[1])}</article>", page, flags=re.S)
        want = article(page)
        assert want and html.main_text(page.replace("<article>", f"<{element}>").replace("</article>", f"</{element}>"), built_in) == want


def test_small_pages(built_in):
    for page in (f"<p>{SAY}</p>", f"<p>{SAY}", SAY, f"<b>{SAY}</b>", f"<html><head><title>x</title></head><body>{SAY}</body></html>", f"<div><p>{SAY}</p></div>", f"<main><p>{SAY}</p></main>", f"<article><p>{SAY}"):
        assert html.main_text(page, built_in) == SAY, page
    for page in (f'<div class="comments"><article><p>{SAY}</p></article></div>', f"<nav><ul><li><a href=1>{SAY}</a></li></ul></nav>", f"<aside><article><p>{SAY}</p></article></aside>", "", "<div></div>"):
        assert html.main_text(page, built_in) == "", page
