"""Page reading, the cut against all labellings, and whole pages."""

import itertools
import random
import time

import pytest

from muster.llm import main_text


def cost(labels, costs, edges):
    return (sum(c[0] if x else c[1] for x, c in zip(labels, costs))
            + sum(w for (u, v), w in edges.items() if labels[u] != labels[v]))


def test_cut_is_least_of_all_labellings():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 9)
        costs = [(rng.random() * 2, rng.random() * 2) for _ in range(n)]
        edges = {(u, v): rng.random() for u in range(n) for v in range(u + 1, n) if rng.random() < 0.5}
        best = min(cost(x, costs, edges) for x in itertools.product([True, False], repeat=n))
        assert cost(main_text.minimum_cut(costs, edges), costs, edges) == pytest.approx(best)


PROSE = "This is a sentence of the article, long enough to be told from a menu. It goes on for a while."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("<nav><a href=x>Home</a></nav>", ""),
    (f"<article><h1>A &amp; B</h1><p>{PROSE}<p> two\n\t <b>bo</b>ld &lt;x&gt;<br>end.</article>",
     f"A & B\n\n{PROSE}\n\ntwo bold <x> end."),
    (f"<body><header><h1>Site</h1></header><div class='sidebar'><p>{PROSE}</p></div><div id=content><p>{PROSE}</p>"
     f"<p>Yes.</p></div><div class=\"cookie-notice\"><p>We use cookies.</p></div><form><label>Your name</label></form>"
     f"<div id='comments'><p>{PROSE}</p></div><footer>&copy; me</footer></body>", f"{PROSE}\n\nYes."),
    (f"<main><p>{PROSE}</p><script>if (a < b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>a < b and c.</p>"
     "<aside>Buy now!</aside></main><noscript>Switch it on</noscript>", f"{PROSE}\n\na < b and c."),
    (f"<article><p>{PROSE}</p><div class=ad>Buy this.</div><p>{PROSE}</p><script>never closed <p>{PROSE}</p>",
     f"{PROSE}\n\n{PROSE}"),
    (f"<p>{PROSE}</p>" * 3, "\n\n".join([PROSE] * 3)),
    (f"<article><p>{PROSE}<div hidden><p>Unseen words.</p></div><p title='a > b'>Last words of it.</article>",
     f"{PROSE}\n\nLast words of it."),
])
def test_pages(page, text):
    assert main_text.extract(page) == text


def test_long_pages_are_whole():
    page = "<article>" + "".join(f"<p>{k} {PROSE}</p>" for k in range(3000)) + "</article>" + "<a \"" * 300
    assert main_text.extract(page).count("\n\n") >= 2999


def test_rows(spark):
    rows = [(1, "u", "<article><p>Ünï of it all.</p></article>", "own"), (None, None, None, "own")]
    pages = spark.createDataFrame(rows * 2, "page_id long, url string, html string, text string")
    found = main_text.extract_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "u", "Ünï of it all.", 14)] * 2 + [(None, None, "", 0)] * 2
    assert main_text.extract_text(pages.limit(0)).count() == 0


PROSE = "<p>" + "This is a sentence of ordinary prose with several words, and it goes on for a while. " * 3 + "</p>"


@pytest.mark.parametrize("wrapper", [
    '<div class="content has-sidebar">', '<main class="with-sidebar">', '<article class="post no-comments">',
    '<div class="blog-post tag-social">', '<div id="page" class="has-cookie-banner">',
    '<div class="content-with-navigation"><article>', '<section class="share-price-news">'])
def test_names_that_only_mention_boilerplate_lose_nothing(wrapper):
    page = f'<html><body><nav><a href="x">Home</a></nav>{wrapper}{PROSE * 5}</div></body></html>'
    assert main_text.extract(page).count("\n\n") == 4


@pytest.mark.parametrize("name", [
    "sidebar", "site-footer", "ad-slot", "related-posts", "comment-list", "cookie-notice", "nav-menu", "footer-links",
    "sidebar-left", "mainNav", "entry-footer"])
def test_names_of_boilerplate_go(name):
    page = f'<html><body><article>{PROSE * 3}</article><div class="{name}"><p>Subscribe now or log in</p></div></body></html>'
    assert "Subscribe" not in main_text.extract(page) and main_text.extract(page).count("\n\n") == 2


def test_deep_nesting_takes_linear_time():
    started = time.process_time()
    main_text.extract("<div>x " * 50_000)
    assert time.process_time() - started < 20
