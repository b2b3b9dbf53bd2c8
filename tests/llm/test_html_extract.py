"""Main text of made pages and of the given ones, whose article element is known."""

import re
from html import unescape

import pytest

from ohmweave.llm.common import table
from ohmweave.llm.html_extract import Page, extract, host_paths

ARTICLE = "<h1>Title</h1><p>First &amp; <b>bold</b>\n  text.<p>Second<br>line &eacute;&#233;.</p><ul><li>one<li>two</ul>"
WANT = "Title\nFirst & bold text.\nSecond line éé.\none\ntwo"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article><footer>(c) us</footer></body></html>",
        f"<body class='has-sidebar'><header>Site</header><div id=main><div class='post-content'>{ARTICLE}</div></div><aside>Related</aside>",
        f"<main>{ARTICLE}<div class='comments'><p>a reader says a lot of things here, more than the text itself does</p></div></main>",
        f"<div class=content>{ARTICLE}<form><p>Sign up<input></form><div class='ad'>Buy now</div><script>if (a < b) '<p>x</p>'</script><style>p {{}}</style></div>",
        f"<article>{ARTICLE}<div role=complementary>side</div><!-- <p>no</p> --><div class='cookie-notice'>We use cookies</div>",
        f"<div class=page><div class=menu><a>One</a><a>Two</a></div><article>{ARTICLE}</article",
    ],
)
def test_article_without_boilerplate(html):
    assert Page(html).text(None) == WANT


@pytest.mark.parametrize(("html", "want"), [("", ""), ("plain  text", "plain text"), ("<p>a &amp", "a &"), ("<p>a &am", "a &am"), ("<p>a <b", "a"), ("<p title='>'>x</p>", "x"), ("<p title=\">x</p> y", "x\ny"), ("<<p>a</p>", "<\na"), ("<p>1 < 2", "1 < 2"), ("<nav>only</nav>", "")])
def test_odd_markup(html, want):
    assert Page(html).text(None) == want


def brute(html):
    m = re.search(r"<article>(.*?)(</article>|$)", html or "", re.S)
    body = re.sub(r"<[^>]*$", "", m[1] if m else "")
    blocks = [" ".join(unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {r.page_id: (r.url, brute(r.html)) for r in pages.collect()}
    got = extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_hosts_agree_on_a_path(spark):
    usual = "<div class='a{}'>" + "<p>" + "long text of the usual kind " * 20 + "</div><div class=b><p>short</div>"
    odd = "<div class='a7'><p>few words</div><div class=b><p>" + "a much longer aside of no interest " * 20 + "</div>"
    rows = [(i, f"http://x.org/{i}", usual.format(i)) for i in range(5)] + [(9, "http://X.org:80/9", odd)] + [(10, "http://y.org/", odd), (11, None, None), (12, "", ""), (12, "", "")]
    df = spark.createDataFrame([(*r, "p", "h") for r in rows], "page_id long, url string, html string, path string, host string")
    assert {r.host: r.path for r in host_paths(df).collect()}["x.org"] == "html>div.a"
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got[9] == "few words"
    assert got[10].startswith("a much longer")
    assert got[11] == got[12] == ""
    assert extract(df).count() == len(rows)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "opening",
    [
        "<div class='content sidebar-right'>",
        "<div class='elementor-widget-container'>",
        "<div class='post share-post'>",
        "<div class='article-with-sidebar'>",
        "<div class='ad-free'>",
        "<div id='search-engines'>",
        "<div data-role='navigation' data-id='menu'>",
        "<div title='class=sidebar'>",
        "<div id=widget>",
        "<form id=form1>",
        "<div class=sidebar><div class=text>",
    ],
)
def test_names_that_only_look_like_boilerplate(opening):
    html = f"<html><body><nav>Home</nav><div class='sidebar'>Other things</div>{opening}{ARTICLE}<div class='post-comments'><p>a reader says a lot of things here, more than the text itself does</p></div></div><div class='cookie-notice'>We use cookies</div>"
    assert Page(html).text(None) == WANT


def test_suspects_with_little_text_go():
    html = f"<body><div class=widget><p>Latest of all</div><div class='page content'>{ARTICLE * 4}</div><div class=share><p>Tell others</div><form><p>Your name</form>"
    assert Page(html).text(None) == "\n".join([WANT] * 4)


def test_empty_winner_falls_back_on_the_page(spark):
    usual = "<div class=a><p>" + "long text of the usual kind " * 20 + "</div>"
    rows = [(i, f"http://x.org/{i}", usual) for i in range(4)] + [(8, "http://x.org/8", "<div class=a></div><section><p>the text of another template</section>"), (9, None, usual), (10, "no host", "<p>own text")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[8] == "the text of another template"
    assert got[9] == got[0]
    assert got[10] == "own text"


@pytest.mark.parametrize("piece", ["<div class='c1'>", "<div class=x><span id=menu>", "<h1>", "<li>", "<p><a href=x>", "</x></div>", "<a title='", "<div class='" + "n " * 50 + "'>"])
def test_deep_nesting_is_linear(piece):
    import time
    import tracemalloc

    n = 40_000
    html = "<article><p>the text</p></article>" + piece * n
    tracemalloc.start()
    begin = time.perf_counter()
    assert Page(html[: 30 * n]).text(None).startswith("the text")
    took, peak = time.perf_counter() - begin, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert took < 60


def test_long_page_is_read_whole():
    html = "<article>" + "".join(f"<p>block {i}</p>" for i in range(50_000))
    assert Page(html).text(None).count("\n") == 49_999


LONG = "Some long sentence of the article goes on here. " * 18


def test_a_teaser_on_the_hosts_path_gives_way_to_the_article():
    page = Page(f"<body><div class=content>Teaser one.</div><article><p>{LONG}</p></article>")
    assert page.text("html>body>div.content") == LONG.strip()
    around = Page(f"<body><div class=page>Lead. <article><p>{LONG}</p></article></div>")
    assert around.text("html>body>div.page") == "Lead.\n" + LONG.strip()


def test_an_article_in_two_containers_is_put_together():
    page = Page(f"<body><div class=content><p>{LONG}</p></div><div class=other><p>{LONG}</p></div><div class=more-text><p>The end. {LONG[:500]}</p></div>")
    assert page.text("html>body>div.content") == f"{LONG.strip()}\nThe end. {LONG[:500].strip()}"


def test_a_page_wrapper_named_after_comments_stays():
    assert Page(f'<body><div class="page comments"><article><p>{LONG}</p></article></div>').text(None) == LONG.strip()
    comments = f'<body><div class=a><p>A short article.</p></div><div class=comments><article class=comment><p>{LONG}</p></article></div>'
    assert Page(comments).text(None) == "A short article."


def test_every_container_with_text_has_its_votes():
    votes = dict(Page("<body><article><p>" + LONG * 30 + "</p></article><section><p>short one</p></section>").votes())
    assert 0 < votes["html>body>section"] < votes["html>body>article"]
    assert sum(votes.values()) <= 10**12
