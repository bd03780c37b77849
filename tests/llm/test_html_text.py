import html
import re

import numpy as np
import pytest

from itemlab.llm import html_text
from itemlab.llm.html_text import main_text

LONG = "Words of the story go on and on, sentence after sentence, until the paragraph is full. " * 3
MENU = "<nav><ul>" + "".join(f"<li><a href=/{k}>Menu item {k}</a></li>" for k in range(8)) + "</ul></nav>"
TEXT = "\n\n".join(["Title here", LONG.strip(), "Short one.", LONG.strip()])
BODY = f"<h1>Title  here</h1><p>{LONG}</p><p>Short\n<b>one</b>.</p><p>{LONG}</p>"
REST = (
    "<aside><p>" + LONG + "</p></aside><div class='cookie-notice'><p>We use cookies. " + LONG + "</p></div>"
    "<form><p>Sign up</p><input name=x></form><div id=sidebar>Recent posts</div><div class='ad'>Buy " + LONG + "</div>"
    "<section id='comments'><article class='comment'><p>First! " + LONG * 4 + "</p></article></section>"
    "<script>var t = '<p>no</p>';</script><style>p {}</style><footer><p>&copy; us</p></footer>"
)


@pytest.mark.parametrize("place", ["article", "main", "div class=content", "div role=main", "section"])
def test_templates(place):
    end = place.split()[0]
    page = f"<html><head><title>T</title></head><body><header><h2>Site</h2></header>{MENU}<{place}>{BODY}</{end}>{REST}</body></html>"
    assert main_text(page) == TEXT


def test_inside_article():
    page = f"<body>{MENU}<main><article><header>{BODY[:20]}</header>{BODY[20:]}{REST}</article></main></body>"
    assert main_text(page) == TEXT


def test_references_and_breaks():
    page = "<article><h1>A &amp; B&nbsp;C</h1><p>one<br>two &lt;x&gt; &#8364;<p>three &copy four</article>"
    assert main_text(page) == "A & B C\n\none two <x> €\n\nthree © four"


@pytest.mark.parametrize("page", [None, "", " ", "<p>", "<script>x", "<!-- only -->", "<nav>menu</nav>", "<footer>f"])
def test_nothing(page):
    assert main_text(page) == ""


def test_broken_pages():
    assert main_text("just text") == "just text"
    assert main_text("<p>" + "word " * 100_000).count("word") == 100_000
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_smoothing_and_threshold():
    assert np.allclose(html_text.smoothed(np.full(7, 3.0)), 3)
    assert 2 < html_text.split_threshold(np.array([1, 2, 1, 50, 60.0])) < 50


def truth(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = html_text.op10_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, truth(pages[r.page_id].html), len(r.text))


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<p>x</p>", 2)],
                               "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_text.extract_text(df).collect()), key=str)
    assert got == [(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)]
    assert html_text.extract_text(df.limit(0)).count() == 0


P = f"<p>{LONG}</p>"


@pytest.mark.parametrize("page, want", [
    (f"<div><h1>Title</h1><p>The lead of it.</p><div class=body>{P * 4}</div></div>", ["Title", "The lead of it.", *[LONG.strip()] * 4]),
    (f"<body><div>Slogan</div><div class=c><p>Intro</p><ul>{f'<li>{LONG}</li>' * 9}</ul><p>Outro</p></div><p>Print</p></body>",
     ["Intro", *[LONG.strip()] * 9, "Outro"]),
    (f"<div><div>{P * 8}</div><p>By us</p><p>Go <a href=/1>to another page</a></p><div>{P}</div></div>",
     [*[LONG.strip()] * 8, "By us", LONG.strip()]),
    (f"<article><h1>A</h1>{P}</article><article><h1>B</h1>{P}</article>", ["A", LONG.strip(), "B", LONG.strip()]),
    (f"<main><h1>Title</h1><p>The lead of it.</p><article>{P * 5}</article></main>", ["Title", "The lead of it.", *[LONG.strip()] * 5]),
    (f"{MENU}<div><h1>Title</h1>{P * 3}</div><article>{P}</article>", ["Title", *[LONG.strip()] * 4]),
])
def test_content_outside_the_place_of_most(page, want):
    assert main_text(page).split("\n\n") == want


@pytest.mark.parametrize("name", ["share-price", "search-results", "ad-hoc", "no-sidebar", "with-comments", "adverb", "headline"])
def test_names_that_only_resemble_boilerplate(name):
    assert main_text(f'<article><h1>Title</h1>{P}<p class="{name}">Some more.</p>{P}</article>').split("\n\n") == [
        "Title", LONG.strip(), "Some more.", LONG.strip()]


@pytest.mark.parametrize("name", ["ad", "ad-slot-1", "site-footer", "cookie_notice", "relatedPosts", "post-comments", "x newsletter-signup"])
def test_names_of_boilerplate(name):
    assert main_text(f'<article>{P}<div class="{name}"><p>{LONG * 3}</p></div>{P}</article>').split("\n\n") == [LONG.strip()] * 2


@pytest.mark.parametrize("before, after", [
    ("<div class='widget Blog' id='Blog1'>", "</div>"),
    ("<div class='content sidebar-right'>", "</div>"),
    ("<form id=aspnet><input type=hidden name=state><input name=q>", "</form>"),
    ("<form id=aspnet><div class='widget'>", "</div></form>"),
    ("<main><div class='content sidebar-right'>", "</div></main>"),
    ("<form><header><h2>Site</h2></header><main>", "</main></form>"),
    ("<div class='modal page'><article>", "</article></div>"),
])
def test_places_that_hold_the_content(before, after):
    text = f"<h1>Title</h1>{P * 4}"
    rest = f"<footer><p>{LONG}</p></footer><div class=comments>{P * 9}</div><div class=cookie-notice>{P}</div>"
    want = ["Title", *[LONG.strip()] * 4]
    assert main_text(f"<body>{MENU}{before}{text}{after}{rest}</body>").split("\n\n") == want
    assert main_text(f"<body>{before}{MENU}{text}{rest}{after}</body>").split("\n\n") == want


@pytest.mark.parametrize("page", [
    f"<article><h1>A</h1><p>{LONG}</p></article><div class=sidebar>{P * 9}</div>",
    f"<main><h1>A</h1><p>{LONG}</p></main><aside>{P * 9}</aside><form>{P * 9}</form>",
    f"<div><h1>A</h1><p>{LONG}</p></div><div class=widget>{P}</div><div id=sidebar>{P}</div>",
    f"<div><h1>A</h1><p>{LONG}</p></div><form>{'<p><label>Your name, as it is in your papers</label><input name=x></p>' * 30}</form>",
])
def test_places_beside_the_content(page):
    assert main_text(page) == "A\n\n" + LONG.strip()


def test_a_page_of_a_form_alone():
    assert main_text("<form><p>Sign up for our letter</p><input name=mail><button>Go</button></form>") == ""


def test_the_ratios_decide(monkeypatch):
    """Random ratios give other texts, and blocks that they put below the threshold aren't returned."""
    page = f"<body><div>{''.join(f'<p><i>a</i> <b>b</b> <i>{k}</i></p>' for k in range(9))}</div><div>{P * 4}</div></body>"
    assert main_text(page).split("\n\n") == [LONG.strip()] * 4
    pages = [r for r in open_pages()]
    right = [main_text(p) for p in pages]
    random = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smoothed", lambda values, sigma=1: random.random(len(values)))
    assert sum(main_text(p) != r for p, r in zip(pages, right, strict=True)) > len(pages) // 5
    monkeypatch.setattr(html_text, "smoothed", lambda values, sigma=1: -np.arange(len(values), dtype=float))
    assert LONG.strip() not in main_text(page)


def open_pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
