"""Labelled training pages: invented pages whose main text is known, for the extractor's random field.

Pages come from a seed. They vary in what tells main text from the rest: semantic elements, class names among unknown ones, plain wrappers
around anything, layout tables, or nothing but the text itself; unclosed tags; headings, lists, tables, quotations, figures and bylines
in the article, and adverts, forms, notices, menus and reader comments too; long boilerplate, short articles, pages that are only text."""

from __future__ import annotations

import random
from collections.abc import Callable

#: Class names and ids by what they hold.
NAMES = {
    "content": "content post entry article story body text main-content post-content entry-content article-body page-content post-body markdown prose".split(),
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav pagination pager toc tabs".split(),
    "header": "header masthead banner top site-header page-header branding topbar logo".split(),
    "footer": "footer bottom colophon site-footer copyright legal page-footer foot".split(),
    "sidebar": "sidebar side widget rail aside related secondary right-column recommended more-stories popular trending".split(),
    "notice": "notice cookie cookies alert consent gdpr banner-message warning popup modal newsletter paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo adsense banner-ad promotion".split(),
    "form": "search login signup subscribe contact-form form search-box".split(),
    "comments": "comments comment comment-list responses discussion replies disqus reader-comments reply".split(),
    "share": "share social sharing tools share-buttons social-links".split(),
}
#: Names that stand anywhere.
LAYOUT = "container wrapper inner outer row col grid box page site root app layout block section module wrap clearfix".split()
_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu al en ir os un tra plo gri ste chu é ü ñ".split()


class _Page:
    """A page that is being written, and the labels of its blocks so far."""

    def __init__(self, seed: int):
        self.r, self.out, self.labels = random.Random(seed), [], []
        self.semantic = self.r.random() < 0.55
        self.unclosed = self.r.random() < 0.3
        self.depth = self.r.choice([0, 0, 1, 1, 2, 4])

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        r = self.r
        marks = [r.choice([".", ".", ".", ".", "!", "?", "###", ""]), r.choice([".", ".", ".", ".", ".", "?", ""])]
        return " ".join(self.words(1, 18).capitalize() + r.choice(marks) for _ in range(r.randint(low, high)))

    def block(self, markup: str, label: int) -> None:
        self.out.append(markup)
        self.labels.append(label)

    def attr(self, kind: str | None = None, named: float = 1.0) -> str:
        """Attributes with a name of the kind, others around it, or only such."""
        r = self.r
        others = [r.choice(LAYOUT) if r.random() < 0.6 else self.words(1, 1) + r.choice(["", "-1", "-" + self.words(1, 1)]) for _ in range(r.choice([0, 0, 1, 2, 6]))]
        if kind is not None and r.random() < named:
            others.insert(r.randint(0, len(others)), r.choice(NAMES[kind]))
        return f' {r.choice(["class", "class", "id"])}="{" ".join(others)}"' if others else ""

    def wrapped(self, fill: Callable[[], None]) -> None:
        """Within plain elements, none to several."""
        r, tags = self.r, []
        for _ in range(r.randint(0, self.depth) if r.random() < 0.6 else 0):
            tags.append("div" if r.random() < 0.85 else "section")
            self.out.append(f"<{tags[-1]}{self.attr()}>")
        fill()
        self.out += [f"</{t}>" for t in reversed(tags)]

    def box(self, kind: str, fill: Callable[[], None]) -> None:
        """An element that tells its kind, by its tag or a name, with plain ones around and within."""
        r = self.r
        semantic = kind in _TAGS and (kind == "form" or self.semantic and r.random() < 0.8)
        tag = _TAGS[kind] if semantic else r.choice(["div", "div", "div", "section", "ul" if kind == "menu" else "div"])

        def inner() -> None:
            self.out.append(f"<{tag}{self.attr(kind, 0.4 if semantic else 1.0)}>")
            self.wrapped(fill)
            self.out.append(f"</{tag}>")

        self.wrapped(inner)

    # -- what surrounds the article

    def links(self) -> None:
        r = self.r
        kind = r.random()
        if kind < 0.75:
            self.out.append("<ul>")
            for _ in range(r.randint(2, 9)):
                self.block(f'<li><a href="/{r.randint(1, 99)}">{self.words(1, 3)}</a></li>' if r.random() < 0.9 else f"<li>{self.words(1, 4)}</li>", 0)
            self.out.append("</ul>")
        elif kind < 0.9:
            self.block("<div>" + r.choice([" | ", "<br>", " "]).join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 6))) + "</div>", 0)
        else:
            for _ in range(r.randint(2, 6)):
                self.block(f'<div><a href="/{r.randint(1, 99)}">{self.words(1, 3)}</a></div>', 0)

    def menu(self) -> None:
        def fill() -> None:
            self.links()
            if self.r.random() < 0.2:
                self.block(f"<p>{self.sentences(1, 2)}</p>", 0)

        self.wrapped(self.links) if self.r.random() < 0.15 else self.box("menu", fill)

    def header(self) -> None:
        def fill() -> None:
            self.block(f"<{(h := self.r.choice(['h1', 'h2', 'p', 'div']))}>{self.words(1, 5)}</{h}>", 0)
            if self.r.random() < 0.4:
                self.block(f"<p>{self.sentences(1, 1)}</p>", 0)
            if self.r.random() < 0.3:
                self.links()

        self.box("header", fill)

    def boiler(self, kind: str) -> None:
        def fill() -> None:
            r = self.r
            if r.random() < 0.4:
                self.block(f"<div>{self.sentences(1, 3)}</div>", 0)
                return
            if r.random() < 0.3:
                self.links()
            for _ in range(r.randint(1, 5)):
                t = r.choice(["p", "p", "h3", "li", "div"])
                inner = self.sentences(1, 3)
                self.block(f"<{t}>" + (f'<a href="#">{inner}</a>' if r.random() < 0.4 else inner) + f"</{t}>", 0)

        self.box(kind, fill)

    def share(self) -> None:
        self.box("share", lambda: [self.block(f'<div><a href="#">{self.words(1, 2)}</a></div>', 0) for _ in range(self.r.randint(1, 5))])

    def form(self) -> None:
        def fill() -> None:
            r = self.r
            for _ in range(r.randint(1, 3)):
                t = r.choice(["label", "p", "div"])
                self.block(f"<div><{t}>{self.words(1, 4)}</{t}><input name=q></div>", 0)
            if r.random() < 0.6:
                self.block(f"<button>{self.words(1, 2)}</button>", 0)

        self.box("form", fill)

    def comments(self) -> None:
        def fill() -> None:
            r = self.r
            if r.random() < 0.6:
                self.block(f"<h3>{self.words(1, 3)}</h3>", 0)
            outer, t = r.choice([("ol", "li"), ("ul", "li"), ("div", "div"), ("div", "article")])
            self.out.append(f"<{outer}>")
            for _ in range(r.randint(1, 6)):
                self.out.append(f"<{t}{self.attr('comments', 0.6)}>")
                if r.random() < 0.5:
                    self.block(f"<div><b>{self.words(1, 2)}</b></div>", 0)
                self.block(f"<p>{self.sentences(1, 6)}</p>", 0)
                self.out.append(f"</{t}>")
            self.out.append(f"</{outer}>")

        self.box("comments", fill)

    def footer(self) -> None:
        def fill() -> None:
            if self.r.random() < 0.3:
                self.links()
            for _ in range(self.r.choice([0, 0, 1, 3])):
                t = self.r.choice(["p", "div", "li", "h4"])
                self.block(f"<{t}>{self.sentences(1, 3)}</{t}>", 0)
            self.block(f"<div>&copy; {self.words(1, 3)} &middot; {self.sentences(0, 2)}</div>" if self.r.random() < 0.6 else f"<p>{self.sentences(1, 2)}</p>", 0)

        self.box("footer", fill)

    def imprint(self) -> None:
        """The last line of a page without a footer."""
        self.wrapped(lambda: self.block(f"<div>&copy; {self.words(1, 3)} &middot; {self.sentences(0, 2)}</div>", 0))

    # -- the article

    def plain(self, text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def paragraph(self) -> None:
        r, kind = self.r, self.r.random()
        text = self.plain(self.sentences(1, 8))
        if self.unclosed and kind < 0.5:
            self.block(r.choice([f"<p><b>{text}<br>", f"<p>{text}", f"<p><i>{text}<br/>"]), 1)
        elif kind < 0.55:
            self.block(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><span>{text}</span></p>", f"<div>{text}</div>", f"<div>{text}<br><br>{text}</div>"]), 1)
        elif kind < 0.67:
            self.block(f"<h{(n := r.randint(2, 4))}>{self.words(1, 8)}</h{n}>", 1)
        elif kind < 0.75:
            linked = r.random() < 0.15
            self.out.append(o := r.choice(["<ul>", "<ol>"]))
            for _ in range(r.randint(1, 6)):
                item = self.words(1, 14)
                self.block(f'<li><a href="/z">{item}</a> {self.words(1, 6)}</li>' if linked else f"<li>{item}</li>", 1)
            self.out.append(o.replace("<", "</"))
        elif kind < 0.8:
            self.out.append("<blockquote>")
            self.block(f"<p>{text}</p>" if r.random() < 0.5 else text, 1)
            self.out.append("</blockquote>")
        elif kind < 0.86:
            self.out.append(f"<table{self.attr()}>")
            for i in range(r.randint(1, 5)):
                t = "th" if i == 0 and r.random() < 0.6 else "td"
                self.out.append("<tr>")
                for _ in range(r.randint(1, 4)):
                    self.block(f"<{t}>{self.words(1, r.choice([2, 2, 12]))}</{t}>", 1)
                self.out.append("</tr>")
            self.out.append("</table>")
        elif kind < 0.9:
            self.out.append('<figure><img src="x.png">')
            self.block(f"<figcaption>{self.sentences(1, 1)}</figcaption>", 1)
            self.out.append("</figure>")
        elif kind < 0.93:
            self.block(f"<pre><code>{self.words(1, 30)}</code></pre>", 1)
        elif kind < 0.95:
            self.out.append("<dl>")
            for _ in range(r.randint(1, 3)):
                self.block(f"<dt>{self.words(1, 3)}</dt>", 1)
                self.block(f"<dd>{self.sentences(1, 2)}</dd>", 1)
            self.out.append("</dl>")
        else:
            self.block(f'<p>{self.words(1, 9)} <a href="/y">{self.words(1, 4)}</a> {text}</p>', 1)

    def head(self) -> None:
        """The article's own heading and byline, which may stand in a header of its own."""
        r, own = self.r, self.semantic and self.r.random() < 0.2
        if own:
            self.out.append("<header>")
        self.block(f"<h{(n := r.choice([1, 1, 1, 2]))}>{self.words(1, 10)}</h{n}>", 1)
        if r.random() < 0.3:
            self.block(r.choice([f'<p class="byline">{self.words(2, 5)}</p>', f'<div class="meta"><time>{self.words(1, 3)}</time></div>', f"<p><em>{self.words(2, 6)}</em></p>"]), 1)
        if own:
            self.out.append("</header>")

    def article(self, fill: Callable[[], None], extras: bool) -> None:
        """Container and content; extras: other things within."""
        r = self.r
        tag, named = r.choices([("article", 0.3), ("main", 0.3), ("section", 0.5), ("div", 1.0), ("div", 0.0), ("", 0.0)], [34, 10, 6, 26, 14, 10] if self.semantic else [0, 0, 4, 50, 28, 18])[0]

        def inner() -> None:
            if tag:
                self.out.append(f"<{tag}{self.attr('content', named)}>")
            if tag == "main" and r.random() < 0.4:
                self.out.append("<article>")
            self.wrapped(fill)
            if tag and extras and r.random() < 0.2:
                self.comments()
            if tag:
                self.out.append(f"</{tag}>")  # and so an article within

        self.wrapped(inner)

    def content(self, extras: bool) -> None:
        r = self.r
        if r.random() < 0.85:
            self.head()
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            self.paragraph() if r.random() < 0.8 else self.wrapped(self.paragraph)
            if extras and r.random() < 0.1:
                r.choice([lambda: self.boiler("advert"), self.share, lambda: self.boiler("notice"), self.form, lambda: self.boiler("sidebar"), lambda: self.menu, self.footer])()


def page(seed: int) -> tuple[str, list[int]]:
    """A page, and for each of its leaf blocks 1 if it is main text."""
    w = _Page(seed)
    r, out = w.r, w.out
    kind = r.random()
    if kind < 0.03:  # no markup but the text's own
        w.block(w.plain(w.sentences(1, 6)), 1)
        return "".join(out), w.labels
    out.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{w.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
    if kind < 0.1:  # nothing but the article
        w.wrapped(lambda: w.content(False)) if r.random() < 0.6 else w.article(lambda: w.content(False), False)
        out.append("</body></html>")
        return "".join(out), w.labels
    table = not w.semantic and r.random() < 0.3
    before = [w.menu, w.header, lambda: w.boiler("advert"), lambda: w.boiler("notice"), w.form, lambda: w.boiler("sidebar")]
    after = [w.comments, lambda: w.boiler("sidebar"), lambda: w.boiler("advert"), lambda: w.boiler("notice"), w.form, w.menu, w.share]

    def whole() -> None:
        for f in before:
            if r.random() < 0.4:
                f()
        if r.random() < 0.3:
            w.menu()
        if table:
            out.append("<table><tr><td>")
            kind = r.random()
            if kind < 0.4:
                w.block(r.choice([" | ", "<br>", " "]).join(f'<a href="/x">{w.words(1, 2)}</a>' for _ in range(r.randint(2, 8))), 0)
            else:
                w.menu() if kind < 0.7 else w.links()
            out.append(f"</td><td{w.attr('content', 0.3)}>")
            w.wrapped(lambda: w.content(True))
            out.append("</td></tr></table>")
        else:
            w.article(lambda: w.content(True), True)
        for f in after:
            if r.random() < 0.25:
                f()
        if r.random() < 0.85:
            w.footer() if r.random() < 0.85 else w.imprint()

    w.wrapped(whole)
    out.append("</body></html>")
    return "".join(out), w.labels
