import html
import math
import re
import time

import numpy as np
import pytest

from ledgerloom.llm.html_text import extract, main_text

ARTICLE = "<article><h1>A &amp; B</h1><p>First  long\nparagraph with <b>bold</b> words &eacute;&#33; and more words still.<p>Short.</p><p>Another paragraph of some length here.</p></article>"
WANT = "A & B\n\nFirst long paragraph with bold words é! and more words still.\n\nShort.\n\nAnother paragraph of some length here."


def page(inside):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>x';</script></head><body>"
        "<header><p>Site name and a long slogan that says a lot of nothing at all</p></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='ad'>Buy this now, it is a very good thing to buy, they say.</div>"
        f"{inside}<aside>See also a long list of other things that you may like.</aside>"
        "<section class='comments'><p>A reader wrote a long and winding comment about all of this.</p></section>"
        "<form><label>Your name</label><input name=q></form><footer>&copy; someone</footer></body></html>"
    )


@pytest.mark.parametrize(
    "inside",
    [ARTICLE, ARTICLE.replace("article>", "main>"), "<div class='content'>" + ARTICLE[9:-10] + "</div>", "<div><div>" + ARTICLE[9:-10] + "</div></div>"],
)
def test_only_the_article_is_left(inside):
    assert main_text(page(inside)) == WANT


@pytest.mark.parametrize("broken", [page(ARTICLE)[: -len("</body></html>")], page(ARTICLE) + "</div></p>", page(ARTICLE).replace("</p>", "")])
def test_broken_markup(broken):
    assert main_text(broken) == WANT


@pytest.mark.parametrize("named", ["layout with-sidebar", "no-sidebar", "container has-nav", "page search-result", "layout layout--has-left-sidebar", "widget-area"])
@pytest.mark.parametrize("inner", [ARTICLE, ARTICLE.replace("article>", "main>"), "<div>" + ARTICLE[9:-10] + "</div>"])
def test_wrappers_named_for_what_they_hold(named, inner):
    long = "A sidebar's words, many of them and none of them of the article. " * 3
    inside = f"<div class='{named}'><div class='top'>{inner}</div><div class='sidebar'>{long if 'p>' in inner and 'div' not in inner else 'Side.'}</div></div>"
    assert main_text(f"<html><body><nav><a href='/'>Home</a></nav>{inside}<footer>f</footer></body></html>") == WANT


def test_words_still_hold_beside_an_article():
    long = "<p>Many words that are not of the article at all.</p>" * 40
    for region in ("comments", "ad", "related", "sidebar"):
        assert main_text(page(ARTICLE + f"<div class='{region}'>{long}</div>")) == WANT
    cards = "".join(f"<article><p>A card about another text, number {k}.</p></article>" for k in range(9))
    assert main_text(page(ARTICLE + f"<section class='related'>{cards}</section>")) == WANT
    assert main_text(page("<div>" + ARTICLE[9:-10] + f"</div><section class='related'>{cards}</section>")) == WANT


def test_title_and_lead_beside_the_body_are_kept():
    body = "<div>" + "".join(f"<p>Paragraph {k} of a long text without any mark of an article around it, as many pages have.</p>" for k in range(12)) + "</div>"
    inside = f"<div><h1>A title</h1><p>A lead.</p>{body}<p>An end.</p></div>"
    for html in (page(inside), f"<html><body>{inside}</body></html>", page(inside[5:-6])):
        got = main_text(html).split("\n\n")
        assert got[:2] == ["A title", "A lead."] and got[-1] == "An end." and len(got) == 15
    links = "<ul><li><a href='/a'>One thing</a></li><li><a href='/b'>Another thing</a></li></ul>"
    assert "thing" not in main_text(f"<html><body>{links}{inside}</body></html>")


def test_edges():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("just text & no tags") == "just text & no tags"
    assert main_text("<p>" * 3000 + "deep") == "deep"
    long = "word " * 200_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_pages_of_the_driver(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract(pages.selectExpr("*", "1 as text", "2 as n_chars")).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", "\n")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_null_pages_and_empty_table(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in extract(pages).collect()] == [("", 0), ("", 0)]
    assert extract(pages.limit(0)).count() == 0


PROSE = "A block of an article that holds a fair number of words, as such blocks do, and {} among them."


@pytest.mark.parametrize("wrap", ["article", "main"])
def test_names_inside_an_article_take_no_content(wrap):
    blocks = [
        "<p>{}</p>", "<div class='legal'><p>{}</p></div>", "<section id='related-work'><p>{}</p></section>", "<p class='promo-code'>{}</p>", "<div class='search-results'>{}</div>",
        "<div class='share-prices'><p>{}</p></div>", "<p id='notice-of-meeting'>{}</p>", "<p>x<sup>2</sup> <math><mi>y</mi></math> <svg><text>z</text></svg> {}</p>", "<p>{}</p>",
    ]
    texts = [PROSE.format(f"number {k}") for k in range(len(blocks))]
    inside = "".join(b.format(t) for b, t in zip(blocks, texts))
    want = [("x2 y z " if "math" in b else "") + t for b, t in zip(blocks, texts)]
    assert main_text(page(f"<{wrap}>{inside}</{wrap}>")).split("\n\n") == want


def test_regions_inside_an_article_go():
    outside = (
        "<aside><p>{0}</p></aside><div class='ad'>{0}</div><div class='box newsletter'><p>{0}</p></div><nav><a href='/'>{0}</a></nav><form><p>{0}</p></form>"
        "<div role='complementary'>{0}</div><footer><p>{0}</p></footer><div id='cookie-notice'>{0}</div><section id='comments'><div><p>{0}</p><p>{0}</p></div></section>"
    ).format(PROSE.format("nothing"))
    assert main_text(page(ARTICLE[:-10] + outside + "</article>")) == WANT


def test_the_clustering_decides(monkeypatch):
    from ledgerloom.llm import html_text

    paragraphs = "".join(f"<p>{PROSE.format(k)}</p>" for k in range(8))
    teaser = "<div><p>A short teaser.</p></div>"
    html = page(ARTICLE.replace("</article>", paragraphs + "</article>"))
    bare = f"<html><body>{teaser}<div>{paragraphs}</div></body></html>"
    whole, plain = main_text(html), main_text(bare)
    assert whole.startswith(WANT) and len(whole.split("\n\n")) == 12 and len(plain.split("\n\n")) >= 8
    real = html_text.content_lines
    monkeypatch.setattr(html_text, "content_lines", lambda lines, spread=1.0: real(lines, spread) & False)
    assert main_text(html) == main_text(bare) == ""

    # Marking one part or the other of a page without an article gives one text or the other.
    links = "<ul>" + "<li><a href='/x'>Some other page of the site</a></li>" * 6 + "</ul>"
    parts = f"<html><body><div><p>One part.</p><p>{PROSE}</p></div>{links}<div><p>{PROSE}</p><p>Other part.</p></div></body></html>"
    for keep, want in ((slice(0, 2), ["One part.", PROSE]), (slice(8, 10), [PROSE, "Other part."])):

        def only(lines, spread=1.0):
            found = np.zeros(len(lines), bool)
            found[keep] = True
            return found

        monkeypatch.setattr(html_text, "content_lines", only)
        assert main_text(parts).split("\n\n") == want


def test_threshold_of_smoothed_ratios():
    from ledgerloom.llm.html_text import PageLines, content_lines

    parser = PageLines()
    parser.feed("<ul>" + "<li><a href='/'>link text here</a></li>" * 8 + "</ul>" + f"<p>{PROSE}</p>" * 3 + "<h2>Short</h2>" + f"<p>{PROSE}</p>" * 3 + "<p class='ad'>Short.</p>")
    parser.close()
    lines = parser.lines
    own = np.log1p([max(0, len(t) - linked) / max(1, tags) * e.factor for t, linked, tags, e in lines])
    weights = [math.exp(-d * d / 2) for d in range(4)]
    smooth = []
    for k in range(len(own)):
        near = [(weights[abs(k - j)], own[j]) for j in range(len(own)) if abs(k - j) < 4]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    smooth[-1] = own[-1]  # the advert has no help from its neighbours
    marked = content_lines(lines).tolist()
    low, high = (np.mean([s for s, m in zip(smooth, marked) if m is side]) for side in (False, True))
    assert marked == [bool(s >= (low + high) / 2) for s in smooth]
    assert marked[11] and not marked[0] and not marked[-1]


def test_deep_pages_take_linear_time():
    def seconds(html):
        begun = time.monotonic()
        main_text(html)
        return time.monotonic() - begun

    for level, stray in (("<div class='content'>", ""), ("<div class='menu'>", "</b>"), ("<section><i>", "</b></p>"), ("<article><b>", "</i>"), ("<b><nav>", "</b>")):
        short, long = ((level * n + "<p>deep text</p>" + stray * n) for n in (5_000, 50_000))
        assert seconds(long) < 12 and seconds(long) < 40 * max(seconds(short), 0.05)
    assert main_text("<div>" * 50_000 + PROSE) == PROSE


def test_head_without_an_end_hides_nothing_of_the_body():
    assert main_text(f"<html><head><title>T</title><body><p>{PROSE}</p></body></html>") == PROSE


LONG = PROSE.format("many more of them") + " " + PROSE.format("others")


@pytest.mark.parametrize("wrapper", ["form", "fieldset", "form><fieldset", "dialog open", "div class='search'", "div id='page' class='modal'"])
@pytest.mark.parametrize("inner", [ARTICLE, ARTICLE.replace("article>", "main>"), f"<div>{ARTICLE[9:-10]}</div>"])
def test_a_wrapper_around_the_page_takes_no_article(wrapper, inner):
    ends = "".join(f"</{w.split()[0]}>" for w in reversed(wrapper.split("><")))
    want = WANT
    menu, foot = "<nav><a href='/'>Home</a></nav>", "<footer>f</footer>"
    assert main_text(f"<html><body><{wrapper}>{menu}{inner}{foot}{ends}</body></html>") == want
    if "article" in inner or "main" in inner:  # marked, it is known beside other parts of the form too
        rest = f"<aside><p>{LONG}</p></aside><div class='ad'>{LONG}</div><label>Your name</label><input name=q>"
        assert main_text(f"<html><body><header><p>Slogan</p></header><{wrapper}>{menu}{inner}{rest if wrapper[:4] == 'form' else ''}{ends}{foot}</body></html>") == want


@pytest.mark.parametrize("named", ["comments", "comment-list", "cookie-banner", "ad", "newsletter", "related-posts", "disqus_thread"])
@pytest.mark.parametrize("as_articles", [False, True])
def test_a_short_article_beside_longer_parts_stays_alone(named, as_articles):
    block = f"<article><p>{LONG}</p></article>" if as_articles else f"<p>{LONG}</p>"
    short = "<article><h1>A post</h1><p>It says little, and then it ends.</p></article>"
    beside = f"<section class='{named}'>{block * 12}</section>"
    want = "A post\n\nIt says little, and then it ends."
    for html in (page(short + beside), page(f"<div>{beside}{short}</div>"), f"<html><body>{short}{beside}</body></html>", page(f"<main>{short[9:-10]}{beside}</main>"), page(f"<div class='post'>{short[9:-10]}</div>{beside}")):
        assert main_text(html) == want


def test_comments_marked_as_articles_are_no_article():
    short = "<article class='post'><p>It says little, and then it ends.</p></article>"
    comments = "".join(f"<article class='comment'><p>{LONG} {k}</p></article>" for k in range(5))
    assert main_text(page(short + comments)) == "It says little, and then it ends."


@pytest.mark.parametrize("foot", ["<div>Copyright 2024 Someone and others. All rights reserved.</div>", "<div><p>&copy; 2024 Someone</p></div>", "<div><span>Imprint and contact</span></div>", "<p>Copyright 2024 Someone</p>"])
@pytest.mark.parametrize("wrap", ["<div>{}</div>", "{}", "<div><div>{}</div></div>"])
def test_an_unnamed_footer_goes(foot, wrap):
    blocks = [PROSE.format(f"number {k}") for k in range(6)]
    body = wrap.format("<h1>A title</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + "<p>An end.</p>")
    assert main_text(f"<html><body><ul><li><a href='/'>Home</a></li></ul>{body}{foot}</body></html>").split("\n\n") == ["A title", *blocks, "An end."]


def test_short_last_paragraphs_in_elements_of_their_own_stay():
    blocks = [PROSE.format(f"number {k}") for k in range(6)] + ["An end."]
    assert main_text("<html><body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body></html>").split("\n\n") == blocks
    assert main_text("<div>Copyright law</div>") == "Copyright law"  # all there is
