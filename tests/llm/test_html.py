import itertools
import random
import time

import pytest

from edgeloom.llm import html


def test_minimum_cut_is_the_cheapest_labelling():
    rnd = random.Random(1)
    for _ in range(1500):
        n = rnd.randint(1, 8)
        terminals = [(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(n)]
        ties = [(a, b, rnd.randint(0, 6)) for a in range(n) for b in range(a) if rnd.random() < 0.5]

        def cost(labels, terminals=terminals, ties=ties):
            return sum(t[0] if x else t[1] for t, x in zip(terminals, labels, strict=True)) + sum(w for a, b, w in ties if labels[a] != labels[b])

        assert cost(html.minimum_cut(terminals, ties)) == min(map(cost, itertools.product((0, 1), repeat=n)))


PAGES = {
    "<article><h1>A  &amp;\n B</h1><p>One<b>two</b> three<br>four.<p>Five &#x41;&nbsp;x</article>": "A & B Onetwo three four. Five A x",
    '<nav><a href="/">Home</a></nav><div class="content"><p>Long enough text of the article goes here.</p><div class="ad">Buy!</div></div>': "Long enough text of the article goes here.",
    "<header><h1>Site</h1></header><main><header><h1>Title of it</h1></header><p>Some words of the text are here.</p><form><p>Your name, please, and mail:</p></form></main><footer>&copy; me</footer>": "Title of it Some words of the text are here.",
    '<article><p>The story is told in these words.</p><section id="comments"><p>First comment of a reader who says a lot here.</p></section></article>': "The story is told in these words.",
    "<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><article><p>Text a < b and so on, really.</p></article>": "Text a < b and so on, really.",
    '<div aria-hidden="true"><p>Hidden words that are quite a few in number.</p></div><article title="a > b"><p>Shown words of this page.</p></article>': "Shown words of this page.",
    "": "",
    "<p": "",
    "<nav>only a menu</nav>": "",
    "Plain words without any markup at all make up this whole page here.": "Plain words without any markup at all make up this whole page here.",
    "<article><ul><li>First entry of a list<li>Second entry of it</ul></article>": "First entry of a list Second entry of it",
    "<table><tr><td>Cell one of this table, with many words<td>Cell two of this table, with many words</table>": "Cell one of this table, with many words Cell two of this table, with many words",
}


RIVER = "The river rose by two metres in the night, and the town had to be left."
WALL = "Nobody was hurt when the water came over the wall, officials told us."
BODY, TEXT = f"<p>{RIVER}</p><p>{WALL}</p>", f"{RIVER} {WALL}"
READER = "<p>I was there and it was far worse than you write here.</p>"
WRAPPED = {
    "has-sidebar": f'<div class="layout has-sidebar"><main>{BODY}</main><div class="sidebar"><p>Most read is the story of a cat that came home.</p></div></div>',
    "form": f'<form id="aspnetForm"><article>{BODY}</article></form>',
    "comments-open": f'<article class="post comments-open">{BODY}</article>',
    "no-header": f'<main class="no-header">{BODY}</main>',
    "sidebar-layout": f'<div class="sidebar-layout"><article>{BODY}</article></div>',
    "comments below": f"<div>{BODY}</div><div><h3>Comments</h3><div>{READER}</div><p>Great story, thank you for it.</p></div>",
    "comments inside": f"<article>{BODY}<h2>3 comments</h2>{READER}<ul><li>So was I, and my dog.</li></ul></article><footer>Made by us here.</footer>",
    "reply": f"<body><article>{BODY}</article><h2>Leave a reply</h2><p>You have to be a member of this site to write here.</p></body>",
    "comment articles": f'<article>{BODY}</article><div id="comments"><article class="comment">{READER}</article></div>',
    "comments area": f'<main><article>{BODY}</article><section class="comments-area">{READER}</section></main>',
    "advert inside": f'<article>{BODY}<div class="ad"><p>Buy this very fine thing today, for it is cheap and good and all your friends have it.</p></div></article>',
    "related": f'<main>{BODY}<div class="related"><article><p>Another river rose too, in another town by another wall, they say.</p></article></div></main>',
    "cookies": f'<div class="cookie-notice"><p>We use cookies to make this page work and to see who reads it.</p></div><div id="content">{BODY}</div><div class="site-footer">Made by us.</div>',
    "aside": f"<aside><article>{READER}</article></aside><article>{BODY}</article>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrappers_and_comments(name):
    assert html.main_text(WRAPPED[name]) == TEXT


def test_the_cut_corrects_single_blocks():
    """Pages where the cheaper label of a block alone is wrong and the cut is right."""
    menu = "".join(f"<li><a href={k}>{x}</a></li>" for k, x in enumerate(["Home", "News of today", "Sport", "Weather"]))
    pages = {
        f"<div><p>{RIVER}</p><div>Nobody home</div><p>{WALL}</p></div>": ("Nobody home", True),
        f"<ul>{menu}<li>All the news that the editors of this page like.</li>{menu}</ul><div>{BODY}</div>": ("All the news that the editors of this page like.", False),
    }
    for page, (text, is_content) in pages.items():
        [(block, label)] = [x for x in html.labelled(page) if x[0].text == text]
        against, for_it = html.costs(block)
        assert label == is_content != (for_it > against)


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html.main_text(page) == PAGES[page]


@pytest.mark.parametrize("page", [*PAGES, *WRAPPED.values()])
def test_text_is_that_of_the_cheapest_labelling(page):
    """All labellings of a page's blocks instead of a flow; of the cheapest ones, that with the fewest content blocks."""
    blocks, elements = html.parsed(page)
    html._weigh(blocks, elements)
    terminals, ties = [html.costs(b) for b in blocks], html.edges(blocks)
    cost = lambda labels: sum(t[0] if x else t[1] for t, x in zip(terminals, labels, strict=True)) + sum(w for a, b, w in ties if labels[a] != labels[b])
    best = min(itertools.product((False, True), repeat=len(blocks)), key=lambda labels: (cost(labels), sum(labels)))
    assert html.main_text(page) == " ".join(b.text for b, x in zip(blocks, best, strict=True) if x)


def test_rows(spark):
    pages = [*enumerate(PAGES), (99, None), (None, "<p>x"), (3, "<nav>a"), (7, "<article>" + "<p>word word</p>" * 30_000 + "</article>")]
    rows = spark.createDataFrame([(i, f"u{i}", h, "t") for i, h in pages], "page_id long, url string, html string, text string")
    got = html.extract(rows).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 99} == {""}
    assert max(r.n_chars for r in got) == 30_000 * 10 - 1
    assert html.extract(rows.limit(0)).count() == 0


HOSTILE = {
    "unfinished tags": "<a" * 100_000,
    "unmatched ends": "<div>" * 100_000 + "</x>" * 100_000,
    "open quotes": '<p a="' * 30_000,
    "ends of outer inline": "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000,
    "quoted ends": '<a b=">" ' * 50_000,
    "long space": "<p class" + " " * 200_000 + ">x",
    "open comments": "<!--" * 100_000,
    "open titles": "<title>" * 100_000,
    "half and half": "<article>" + "<p>Some good words are here.</p>" * 5000 + "</article>" + "<nav><p>Home</p></nav>" * 5000,
    "in turn": "<div>" + "<p>Words that are many and stand in a line here.</p><ul><li><a>x</a></li></ul>" * 5000,
    "references": "&#" * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.perf_counter()
    html.main_text(HOSTILE[name])
    assert time.perf_counter() - began < 2


def test_hostile_pages_end():
    assert html.main_text('<p a="' * 3000) is not None
    assert html.main_text("<b>" * 20_000 + "some words that stand in very deep markup indeed") is not None
    assert html.main_text("</p></div>" * 20_000) == ""
