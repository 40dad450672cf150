"""The extractor on pages written by hand, in layouts that aren't those of its training pages' generator."""

import pytest

from lodestar.llm.dom_blocks import blocks
from lodestar.llm.html_extract import main_text, trained

P = [
    "The harbour was quiet when the first boats came back, and the fishermen carried their nets up to the sheds.",
    "By noon the market had filled; traders from the hills sold cheese, honey and wool next to the fish stalls.",
    "Nobody had expected such a crowd on a Tuesday, said the mayor, who had walked down from the town hall.",
    "The council will decide next month whether the market may open on Sundays as well.",
    "Until then the stalls close at six, and the square belongs to the children again.",
    "A short note follows.",
]
ps = "".join(f"<p>{p}</p>" for p in P)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Harbour News. All rights reserved.</p></footer>"

#: (name, html, the blocks of main text)
PAGES = [
    (
        "weblog",
        f"""<html><body class="home blog wp-custom"><div id="page" class="hfeed site"><header id="masthead" class="site-header" role="banner"><div class="site-branding">
        <p class="site-title"><a href="/">My weblog</a></p><p class="site-description">Notes from the coast</p></div><nav id="site-navigation" class="main-navigation"><div class="menu-main">
        <ul class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/c">Contact</a></li></ul></div></nav></header>
        <div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-17" class="post type-post hentry">
        <header class="entry-header"><h1 class="entry-title">Market day</h1></header><div class="entry-content"><div class="wp-block-group"><div class="wp-block-inner">{ps}</div></div>
        <blockquote class="wp-block-quote"><p>We have never seen so many people here before.</p></blockquote></div></article>
        <div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely story, thank you for sharing it with us!</p></li>
        <li class="comment"><p>I was there too, and it rained all afternoon.</p></li></ol></div></main></div>
        <aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent posts</h2><ul><li><a href="/1">Storm</a></li><li><a href="/2">Boats</a></li></ul></section></aside></div>
        <footer id="colophon" class="site-footer"><div class="site-info"><a href="/p">Proudly powered by a press</a></div></footer></div></body></html>""",
        ["Market day", *P, "We have never seen so many people here before."],
    ),
    ("plain wrapper in an article", f"<html><body>{NAV}<article><div>{ps}</div></article>{FOOT}</body></html>", P),
    ("many wrappers", f"<html><body><div><div>{NAV}</div><div><div><div><div><h1>Market day</h1>{ps}</div></div></div></div><div>{FOOT}</div></div></body></html>", ["Market day", *P]),
    ("paragraphs alone", f"<html><body>{ps}</body></html>", P),
    ("two paragraphs", f"<p>{P[0]}</p><p>{P[1]}</p>", P[:2]),
    ("plain text", " ".join(P), [" ".join(P)]),
    (
        "unknown names",
        f"""<html><body><div class="x-7f3a2"><div class="css-1q2w3e"><ul><li><a href="/">Start</a></li><li><a href="/b">Archive</a></li><li><a href="/c">Shop</a></li></ul></div>
        <div class="sc-bdVaJa kQxYzz"><h1 class="sc-htpNat">Market day</h1><div class="sc-bxivhb">{ps}</div></div><div class="css-9z8y7x"><div>© 2024 Harbour News</div></div></div></body></html>""",
        ["Market day", *P],
    ),
    (
        "table of data in an article",
        f"""<html><body>{NAV}<article><h1>Prices</h1><p>{P[0]}</p><table class="data"><thead><tr><th>Good</th><th>Price</th></tr></thead><tbody><tr><td>Cheese</td><td>4.20</td></tr>
        <tr><td>Honey</td><td>6.00</td></tr></tbody></table><p>{P[1]}</p></article>{FOOT}</body></html>""",
        ["Prices", P[0], "Good", "Price", "Cheese", "4.20", "Honey", "6.00", P[1]],
    ),
    (
        "layout table of the nineties",
        f"""<html><body bgcolor=white><table width="100%"><tr><td width=150><a href="a.html">Home</a><br><a href="b.html">Links</a><br><a href="c.html">Guestbook</a></td>
        <td><h1>Market day</h1><p>{P[0]}<p>{P[1]}<p>{P[2]}</td></tr></table></body></html>""",
        ["Market day", *P[:3]],
    ),
    (
        "documentation",
        f"""<html><body><header class="md-header"><div class="md-header__title">Toolkit</div></header><div class="md-container"><main class="md-main"><div class="md-main__inner"><div class="md-sidebar md-sidebar--primary">
        <nav class="md-nav"><ul><li class="md-nav__item"><a href="i">Install</a></li><li class="md-nav__item"><a href="u">Usage</a></li></ul></nav></div><div class="md-content"><article class="md-content__inner md-typeset">
        <h1 id="install">Install</h1><p>Unpack the archive into a folder of your own, then run the installer from there.</p><pre><code>tar xf toolkit.tar; ./install</code></pre><h2>Options</h2><ul><li>--fast skips the tests</li>
        <li>--quiet prints nothing</li></ul><dl><dt>prefix</dt><dd>Where the files go.</dd></dl></article></div></div></main></div><footer class="md-footer"><div>Made with care</div></footer></body></html>""",
        [
            "Install",
            "Unpack the archive into a folder of your own, then run the installer from there.",
            "tar xf toolkit.tar; ./install",
            "Options",
            "--fast skips the tests",
            "--quiet prints nothing",
            "prefix",
            "Where the files go.",
        ],
    ),
    (
        "news with things in between",
        f"""<html><body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div>{NAV}<main><article class="story"><h1>Market day</h1><p class="byline">By Ann Shore</p><p>{P[0]}</p>
        <div class="ad-slot advertisement"><p>Buy two, get one free, today only!</p></div><p>{P[1]}</p><aside class="related"><h3>More on this</h3><ul><li><a href="/x">Storm hits the coast</a></li></ul></aside>
        <p>{P[2]}</p><figure><img src=a.jpg><figcaption>The square at noon.</figcaption></figure><form class="newsletter-signup"><label>Your address</label><input><button>Sign up</button></form><p>{P[3]}</p>
        <div class="social-share"><a href="#">Share</a> <a href="#">Tweet</a></div><section class="comments"><h3>Comments</h3><div class="comment"><p>{P[4]}</p></div></section></article></main>{FOOT}</body></html>""",
        ["Market day", "By Ann Shore", P[0], P[1], P[2], "The square at noon.", P[3]],
    ),
    (
        "encyclopedia",
        f"""<html><body class="mediawiki"><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">Harbour</h1><div id="bodyContent"><div id="mw-content-text"><div class="mw-parser-output">
        <p>{P[0]}</p><h2><span class="mw-headline">History</span></h2><p>{P[1]}</p><ul><li>First item of a list</li><li>Second item of a list</li></ul></div></div></div></div>
        <div id="mw-navigation"><div role="navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li></ul></div></div><div id="footer" role="contentinfo"><ul><li>This page was last edited in May.</li></ul></div></body></html>""",
        ["Harbour", P[0], "History", P[1], "First item of a list", "Second item of a list"],
    ),
    (
        "aside under many spans",
        f"<html><body>{NAV}<article><h1>Market day</h1><p>{P[0]}</p><aside>{'<span>' * 30}<div><p>{P[1]}</p><p>{P[2]}</p></div>{'</span>' * 30}</aside><p>{P[3]}</p></article></body></html>",
        ["Market day", P[0], P[3]],
    ),
    (
        "a long list of names",
        f'<html><body>{NAV}<article><h1>Market day</h1><p>{P[0]}</p></article><div class="a b c d e f g h i j k l sidebar"><p>{P[1]}</p><p>{P[2]}</p></div></body></html>',
        ["Market day", P[0]],
    ),
    (
        "formula and drawing",
        f"<html><body>{NAV}<article><p>The area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> square miles.</p><p>A <svg><text>chart</text></svg> shows it. <noscript>Pictures are off.</noscript></p><p>{P[0]}</p></article>{FOOT}</body></html>",
        ["The area is x=2 square miles.", "A chart shows it. Pictures are off.", P[0]],
    ),
    (
        "text without paragraphs",
        f"<html><body><div id=header><a href=/>Harbour News</a></div><div id=story><h2>Market day</h2>{P[0]}<br><br>{P[1]}<br><br>{P[2]}</div><div id=footer>&copy; Harbour News</div></body></html>",
        ["Market day", " ".join(P[:3])],
    ),
]


def _counts(markup, want):
    got = [t for t in main_text(markup, trained()).split("\n\n") if t]
    hit = sum(1 for t in got if t in want)
    return hit, len(got), len(want), got


@pytest.mark.parametrize("name,markup,want", PAGES, ids=[p[0] for p in PAGES])
def test_page(name, markup, want):
    assert _counts(markup, want)[3] == want


@pytest.mark.parametrize("outer", ["aside", "nav", "form", "footer"])
@pytest.mark.parametrize("inner", ["span", "div", "b"])
@pytest.mark.parametrize("depth", [0, 1, 8, 24, 60])
def test_depth_changes_no_label(outer, inner, depth):
    within = f"<{inner}>" * depth + "".join(f"<div>{p}</div>" for p in P[1:]) + f"</{inner}>" * depth
    markup = f"<body><article><h1>Market day</h1><p>{P[0]}</p><{outer}>{within}</{outer}><p>{P[3]}</p></article></body>"
    assert _counts(markup, ["Market day", P[0], P[3]])[3] == ["Market day", P[0], P[3]]
    wrapped = f"<body>{NAV}" + f"<{inner}>" * depth + f"<article>{ps}</article>" + f"</{inner}>" * depth + "</body>"
    assert _counts(wrapped, P)[3] == P


def test_very_deep_and_very_long_pages():
    deep = "<article>" + "<div class='x y z'>" * 30_000 + f"<p>{P[0]}</p>"
    assert main_text(deep, trained()) == P[0]
    assert main_text("<article>" + ps * 20_000 + "</article>", trained()).count("\n\n") == 6 * 20_000 - 1
    assert len(blocks("<div>" * 5000 + "<p>x" * 5000)) == 5000
