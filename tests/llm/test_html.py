import random

import pytest

from claimscope.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";x(1)</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>One, two, three</a></li><li><a href=/b>Four</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as you know, and so on, for a better site.</p></div><div class="ad">Buy, buy, buy this now</div>
{body}
<aside class="sidebar"><p>Related: <a href=/c>a long list, of links, to read</a></p></aside>
<section id="comments"><p>First! I disagree, strongly, with all of this article, as always.</p></section>
<form><p>Subscribe, please, to our letter</p><input></form><footer><p>&copy; me, 2024, all rights</p></footer></body></html>"""
BLOCKS = ["Head &amp; line", "First para, with a <b>bold\n  word</b>, and more of it.", "Second&nbsp;one, short.<br>After the break", "Third, the <a href=x>only link</a> here, in a longer paragraph of words."]
TEXT = "Head & line\nFirst para, with a bold word, and more of it.\nSecond one, short. After the break\nThird, the only link here, in a longer paragraph of words."


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></article>",
        "<main><h1>{}</h1><p>{}<p>{}<p>{}</main>",
        "<div class=content><h2>{}</h2><p>{}</p><p>{}</p><p>{}</p></div>",
        "<div><div><h2>{}</h2><p>{}</p></div></div><div hidden><p>no, no, no</p></div>".replace("</p></div></div>", "</p><p>{}</p><p>{}</p></div></div>"),
    ],
)
def test_main_text(body):
    assert html.main_text(PAGE.format(body=body.format(*BLOCKS))) == TEXT


def test_odd_pages():
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<p>") == ""
    assert html.main_text("just text &lt;3") == "just text <3"
    assert html.main_text("<p><b>One<br><p>Two</b></p>") == "One\nTwo"
    assert html.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert html.main_text("<ul><li>x<ul><li>y</ul><li>z</ul>") == "x\ny\nz"
    assert html.main_text("</div></p><p>stray") == "stray"
    deep = "<div>" * 20_000 + "<p>deep, deep</p>"
    assert html.main_text(deep) == "deep, deep"


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a\U0001f600 b</p>", "old"), (1, "u", "<p>a\U0001f600 b</p>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert rows == [(1, "a\U0001f600 b", 4), (1, "a\U0001f600 b", 4), (2, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


PARAS = "<p>First para, with words, and more of it here for length.</p><p>Second para, also with words and such things.</p>"
WANT = "First para, with words, and more of it here for length.\nSecond para, also with words and such things."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<div class="layout no-sidebar">{}</div>', WANT),
        ('<div class="page-with-sidebar">{}<div class="sidebar"><p>side, text, here</p></div></div>', WANT),
        ('<article class="post has-comments">{}<div class="comments"><p>c, c, c</p></div></article>', WANT),
        ('<section id="header-article">{}</section>', WANT),
        ('<div class="content-sidebar"><main>{}</main></div>', WANT),
        ("<main><form>{}</form></main>", WANT),
        ('<div class="banner">{}</div>', WANT),
        ("<article><header><h1>Title</h1></header>{}</article>", f"Title\n{WANT}"),
        ('<article><div class="entry-header"><h1>Title</h1></div>{}</article>', f"Title\n{WANT}"),
        ("<div>loose text<div>{}</div>more <b>loose</b></div>", f"loose text\n{WANT}\nmore loose"),
        (f"<div><div>{PARAS}</div></div><div><div>{{}}</div></div>", f"{WANT}\n{WANT}"),
        ('<div>{}</div><div class="comments"><p>' + "I say, you say, no. " * 50 + "</p></div>", WANT),
        ('<article>{}<ul><li><a href=a>More here</a></li><li><a href=b>And there</a></li></ul></article>', WANT),
        ('<article>{}<div class="related-post"><p>Read, also, this</p></div><div class="ad-container">Buy</div></article>', WANT),
        ('<article><div class="market-share-table">Shares of the market</div>{}</article>', f"Shares of the market\n{WANT}"),
        ('<article><section class="social-policy"><h2>Policy</h2><p>On social policy, and more.</p></section>{}</article>', f"Policy\nOn social policy, and more.\n{WANT}"),
        ('<article><p class="copyright">' + "Copyright law protects works, songs and texts. " * 3 + "</p>{}</article>", ("Copyright law protects works, songs and texts. " * 3).strip() + f"\n{WANT}"),
        ('<article>{}<p class="copyright">Copyright 2024 by the house, all rights reserved, and no part of this page may be copied.</p></article>', WANT),
        ('<article>{}<div class="share-buttons">Share this</div><div class="social">Follow</div></article>', WANT),
        ('<div class="alert">We use cookies, as all do.</div><article>{}</article>', WANT),
        ('<div class="post">{}</div><div class="user-discussion"><p>I say, you say, no.</p></div>', WANT),
        ("<article>{}</article><article>" + PARAS + "</article>", f"{WANT}\n{WANT}"),
        ("<article>{}</article><article><h3><a href=x>Another story, elsewhere</a></h3></article>", WANT),
    ],
)
def test_names_of_wrappers_and_split_texts(body, want):
    page = '<html><body><nav><a href="/">home</a></nav>' + body.format(PARAS) + "<footer>foot, note</footer></body></html>"
    assert html.main_text(page) == want


def test_a_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i}, with a few words.</p>" for i in range(50_000)) + "</article>"
    assert html.main_text(page).count("\n") == 49_999


def naive_scores(order):
    """By the definition: every paragraph to each of its 12 nearest containers."""
    out = {}
    for n in order:
        up, chain = n if n.tag not in html.PARAGRAPH else n.parent, []
        while up is not None:
            chain.append(up)
            up = up.parent
        for level, c in enumerate(chain[:12], 1):
            out[id(c)] = out.get(id(c), 0) + html.paragraph_points(n) / level
    return out


def test_scores_equal_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        parts = []
        for _ in range(60):
            parts.append(rng.choice(["<div>", "</div>", "<section>", "</section>", "<p>a, b and c", "</p>", "<ul><li>one, two", "</ul>", "<a href=x>link</a>", "text, loose", "<nav>", "</nav>", "<b>bold</b>"]))
        tree = html._Tree()
        tree.feed("".join(parts))
        tree.close()
        html._settle(tree.order)
        scored = html._score(tree.order)
        want = naive_scores(tree.order)
        for n in scored:
            assert n.score == pytest.approx(want[id(n)] * (1 - n.links / n.length if n.length else 0))
        assert {id(n) for n in scored} == {k for k, v in want.items() if v > 0}
