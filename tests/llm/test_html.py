"""Pages whose main text is known by how they are made."""

import math

import pytest

from pyrocell.llm import html_text

PROSE = [f"Paragraph {i} of the article, with plenty of words in it, and some more of them." for i in range(3)]
REPLIES = [f"A reader's reply, number {i}, is long as well and has many words of its own." for i in range(8)]
PIECES = ["<header><h1>The title</h1></header>", *(f"<p>{x}</p>" for x in PROSE), "<figure><img src=x><figcaption>Caption</figcaption></figure>", "<ul><li><a href=it's>ref one</a></li><li><a href=y>ref two</a></li></ul>"]
ARTICLE = f"<article>{''.join(PIECES)}</article>"
WANT = ["The title", *PROSE, "Caption", "ref one", "ref two"]
TEXT = "".join(f"<p>{x}</p>" for x in REPLIES)


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=/>home</a></nav>{ARTICLE}<section class='comments'>{TEXT}</section>",
        f"<header><h1>Site</h1></header>{ARTICLE}<footer>{TEXT}</footer>",
        f"<div class='content has-sidebar'><div title='the hidden truth' style='overflow:hidden'>{ARTICLE}</div></div><div class=sidebar>{TEXT}</div>",
        f"<form action=x>{ARTICLE}<input><button>Send</button></form>",
        f"<div class='post related-posts-on'>{ARTICLE}</div><div id=comments><article class=comment-body>{TEXT}</article></div>",
        f"<script>var a = '<p>no</p>';</script><div class=ad>{REPLIES[0]}</div><div hidden>{TEXT}</div>{ARTICLE}<!-- {TEXT} -->",
    ],
)
def test_only_the_article_stays(page):
    assert html_text.extract(f"<html><body>{page}</body></html>").split("\n\n") == WANT


def test_the_threshold_joins_containers_of_one_article():
    part = lambda name, more: f"<div id={name}>{''.join(f'<p>{x}{more}</p>' for x in PROSE)}</div>"
    links = "<div><ul><li><a href=x>one link</a><li><a href=y>two</a></ul></div>"
    assert html_text.extract(links + part("a", "") + part("b", " Again.") + links).split("\n\n") == [*PROSE, *(f"{x} Again." for x in PROSE)]


def test_broken_empty_and_deep_pages(spark):
    assert html_text.extract("<div>" * 50_000 + "deep text") == "deep text"
    assert html_text.extract('<a href="x>text</a><p>more') == "text\n\nmore"
    assert html_text.extract("<p>a&amp;b<b>c") == "a&bc"
    assert html_text.extract("<nav>menu</nav>") == html_text.extract(None) == html_text.extract("") == ""
    rows = [(1, "u", ARTICLE, 1), (1, "u", ARTICLE, 2), (None, None, None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.main_text(pages).collect())
    text = "\n\n".join(WANT)
    assert got == [(0, "", 0), (1, text, len(text)), (1, text, len(text))]
    assert html_text.main_text(pages.limit(0)).count() == 0


LINES = [f"Paragraph {k} of the article has many words, a comma or two, and says something about rivers, roads and towns." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in LINES)


def written(inside="", after="", article=True):
    tag = "article" if article else "div"
    return f"<html><body><nav><a href=/>Home</a></nav><{tag}><h1>Title</h1>{BODY}{inside}</{tag}>{after}<footer>All rights</footer></body></html>"


def same(html, *more):
    assert html_text.extract(html) == "\n\n".join(["Title", *LINES, *more])


@pytest.mark.parametrize("name", "related-work share-price menu-of-the-day social-history footer-note notice-of-change promotion-history navy widget discussion author-note has-sidebar no-comments".split())
def test_sections_of_an_article_stay_whatever_their_name_begins_with(name):
    text = "A section of the article that has its own long sentence about prices, history and the sea."
    same(written(f'<section class="{name}"><p>{text}</p></section>'), text)


@pytest.mark.parametrize("name", "ad banner-ad google-ads c-footer l-sidebar alert modal gdpr-banner discussion replies responses recommended author-bio comments comments-list post-comments ad-slot-1 related-posts share-buttons sidebarLeft cookie-notice widget newsletter-signup".split())
def test_what_stands_beside_an_article_goes(name):
    text = "Words that are no part of the article, though they are as long and as plain as a sentence of it, and without a link."
    same(written(after=f'<div class="{name}"><p>{text}</p><p>{text}</p></div>'))


@pytest.mark.parametrize("name", "ad banner-ad google-ads comments share-buttons newsletter-signup related-posts cookie-notice".split())
def test_adverts_and_comments_inside_an_article_go(name):
    same(written(inside=f'<div class="{name}"><p>Words that are no part of the article, and without a link, long as they are.</p></div>'))


def test_a_second_short_article_belongs_to_the_page():
    same(written(after="<article><h2>Later</h2><p>A short note.</p></article>"), "Later", "A short note.")
    same(written(after='<article><h2><a href="/x">Another page</a></h2><p>What it is about, in a sentence.</p></article>'))


def test_references_under_a_heading_stay_without_an_article_element():
    links = "".join(f'<li><a href="/{k}">Source number {k} of the page</a></li>' for k in range(3))
    same(written(inside=f"<h2>References</h2><ul>{links}</ul>", article=False), "References", *(f"Source number {k} of the page" for k in range(3)))
    same(written(inside=f"<ul>{links}</ul>", article=False))


def plain_density(chars, tags, links, link_tags, body_chars, body_links):
    """The formula as the module's docstring has it."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, links), max(1, link_tags)
    inner = math.log(chars * links / max(1, chars - links) + body_links / body_chars * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1 + 1e-9)) / math.log(inner + math.e - 1)


def test_densities_are_those_of_a_recursive_count():
    root = html_text.parse(written(inside='<div>Some <b>bold</b> text and <a href="#">a link of <i>its</i> own</a></div><ul><li><a>one</a></li><li>two words</li></ul>', after="<div><p>Outside of it</p></div>"))
    nodes = html_text.measure(root)

    def count(n, linked=False):
        linked = linked or n.tag == "a"
        total = [0, 0, 0, 0]
        for x in n.items:
            if isinstance(x, str):
                k = len(" ".join(x.split()))
                total[0] += k
                total[2] += k * linked
            elif x.kind == html_text.PLAIN:
                c = count(x, linked)
                total = [a + b for a, b in zip(total, (c[0], c[1] + 1, c[2], c[3] + (x.tag == "a" or linked)))]
        return total

    whole = count(root)
    for n in nodes:
        c, t, lc, lt = count(n)
        inside = n
        while inside is not None and inside.tag != "a":
            inside = inside.parent
        if inside is None:
            assert n.density == pytest.approx(plain_density(c, t, lc, lt, whole[0], whole[2]))
            assert n.sums == pytest.approx(sum(x.density for x in n.nodes() if x.kind == html_text.PLAIN))
