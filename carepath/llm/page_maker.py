"""Labelled web pages of many layouts, made from a seed, to train the page model on."""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "an be co da en fi go ha in ka lo me no or pa re so ta un vi".split()


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.kept: set[str] = set()
        self.k = 0

    def text(self, least: int, most: int, content: bool) -> str:
        """Words that occur nowhere else on the page, so that a text stands for its place."""
        self.k += 1
        words = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(least, most))]
        words[0] = words[0].capitalize() + str(self.k)
        out = " ".join(words) + self.r.choice([".", ".", "", "!"])
        if content:
            self.kept.add(out)
        return out

    def links(self, n: int, each: str = "<li><a href='/{0}'>{0}</a></li>") -> str:
        return "".join(each.format(self.text(1, 3, False)) for _ in range(n))

    def paragraph(self) -> str:
        r = self.r
        kind = r.random()
        short = r.random() < 0.3
        words = (1, 4) if short else (8, 90)
        if kind < 0.7:
            t = self.text(*words, True)
            # a link or emphasis inside a paragraph leaves its text as it is
            if r.random() < 0.3 and " " in t:
                a, b = t.split(" ", 1)
                return f"<p><{(e := r.choice(['b', 'em', 'a', 'span']))}>{a}</{e}> {b}</p>"
            return f"<p>{t}</p>" if r.random() < 0.85 else f"<p>{t}"
        if kind < 0.8:
            return f"<h{(h := r.randint(2, 4))}>{self.text(1, 9, True)}</h{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.text(2, 20, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{self.text(5, 40, True)}</p></blockquote>"
        if kind < 0.93:
            return "<table><tr>" + "".join(f"<td>{self.text(1, 6, True)}</td>" for _ in range(r.randint(2, 6))) + "</tr></table>"
        if kind < 0.95:
            return f"<pre>{self.text(3, 30, True)}</pre>"
        if kind < 0.97:
            return f"<figure><img src='x'><figcaption>{self.text(3, 12, True)}</figcaption></figure>"
        return f"<div>{self.text(6, 60, True)}</div>"

    def advert(self) -> str:
        r = self.r
        name = r.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo-box", "advertisement"])
        inner = self.text(3, 25, False)
        return r.choice([f'<div class="{name}">{inner}</div>', f'<aside class="{name}"><p>{inner}</p></aside>', f'<div id="{name}"><p>{inner}</p><a href="#">{self.text(1, 3, False)}</a></div>', f"<aside>{inner}</aside>"])

    def menu(self) -> str:
        r = self.r
        items = self.links(r.randint(3, 9))
        return r.choice([f"<nav><ul>{items}</ul></nav>", f'<div class="menu"><ul>{items}</ul></div>', f'<div id="nav">{self.links(5, "<a href=/x>{0}</a> ")}</div>', f"<ul class=navbar>{items}</ul>", f'<nav role="navigation">{self.links(4, "<a href=/y>{0}</a> | ")}</nav>', f"<ul>{items}</ul>"])

    def header(self) -> str:
        r = self.r
        name = self.text(1, 5, False)
        return r.choice([f"<header><h1>{name}</h1><p>{self.text(3, 10, False)}</p></header>", f'<div class="header"><div class="logo"><a href="/">{name}</a></div></div>', f'<header class="masthead"><a href="/">{name}</a>{self.menu()}</header>', f'<div id="top-bar">{name}</div>'])

    def footer(self) -> str:
        r = self.r
        note = self.text(4, 30, False)
        return r.choice([f"<footer>&copy; {note}</footer>", f"<footer><p>{note}</p><ul>{self.links(3)}</ul></footer>", f'<div class="footer"><p>{note}</p></div>', f'<div id="site-footer">{note}<br>{self.text(3, 9, False)}</div>'])

    def sidebar(self) -> str:
        r = self.r
        inner = f"<h3>{self.text(1, 4, False)}</h3><ul>{self.links(r.randint(2, 6))}</ul>" + (f"<p>{self.text(5, 40, False)}</p>" if r.random() < 0.5 else "")
        return r.choice([f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<aside class="widget-area"><section>{inner}</section></aside>', f'<div id="related-posts">{inner}</div>'])

    def notice(self) -> str:
        r = self.r
        inner = self.text(5, 40, False)
        return r.choice([f'<div class="cookie-notice"><p>{inner}</p><button>{self.text(1, 2, False)}</button></div>', f'<div id="consent" role="dialog">{inner}</div>', f'<div class="notice">{inner}</div>', f'<section class="newsletter"><h4>{self.text(2, 5, False)}</h4><p>{inner}</p></section>', f'<div role="alert">{inner}</div>'])

    def form(self) -> str:
        r = self.r
        return r.choice([f"<form><label>{self.text(1, 4, False)}</label><input name=q><button>{self.text(1, 2, False)}</button></form>", f'<form class="search"><p>{self.text(2, 9, False)}</p><input></form>', f"<form action=/s><fieldset><div>{self.text(2, 12, False)}</div></fieldset></form>"])

    def comments(self) -> str:
        r = self.r
        n = r.randint(1, 5)
        one = lambda: f'<div class="comment"><p class="author">{self.text(1, 3, False)}</p><p>{self.text(3, 60, False)}</p></div>'
        return r.choice([
            f'<section id="comments"><h2>{self.text(1, 3, False)}</h2>' + "".join(one() for _ in range(n)) + "</section>",
            '<div class="comments">' + "".join(one() for _ in range(n)) + "</div>",
            '<ol class="commentlist">' + "".join(f"<li><p>{self.text(3, 50, False)}</p></li>" for _ in range(n)) + "</ol>",
            '<section class="comments">' + "".join(f'<article class="comment"><p>{self.text(3, 50, False)}</p></article>' for _ in range(n)) + "</section>",
        ])

    def article(self) -> str:
        r = self.r
        title, semantic = f"<h1>{self.text(2, 12, True)}</h1>", r.random() < 0.45
        if semantic and r.random() < 0.3:
            title = f"<header>{title}</header>"
        parts = [title if r.random() < 0.85 else ""] + [self.paragraph() for _ in range(r.randint(1, 12))]
        for extra, share in ((self.advert, 0.3), (lambda: f'<div class="share">{self.links(3, "<a href=#>{0}</a> ")}</div>', 0.15), (self.sidebar, 0.08), (self.form, 0.08), (self.comments, 0.1)):
            if r.random() < share:
                parts.insert(r.randint(1, len(parts)), extra())
        body = "".join(parts)
        if r.random() < 0.2:
            body = r.choice([f'<div class="entry-content">{body}</div>', f'<section>{body}</section>', f'<div class="article-body">{body}</div>', f"<div>{body}</div>"])
        if semantic:
            return f"<article>{body}</article>"
        return r.choice([f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div id="content">{body}</div>', f'<div class="post">{body}</div>', f'<section class="story">{body}</section>', f'<div class="main-content"><div class="text">{body}</div></div>', f'<div role="main">{body}</div>'])

    def page(self) -> str:
        r = self.r
        before = [f() for f, share in ((self.header, 0.6), (self.menu, 0.9), (self.notice, 0.4), (self.advert, 0.6), (self.form, 0.3), (self.sidebar, 0.2)) if r.random() < share]
        after = [f() for f, share in ((self.comments, 0.4), (self.sidebar, 0.4), (self.advert, 0.3), (self.form, 0.2), (self.notice, 0.2), (self.footer, 0.95)) if r.random() < share]
        r.shuffle(before)
        inner = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.3:
            inner = f'<div {r.choice(["id=page", "class=wrapper", "class=container", "id=root"])}>{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.text(2, 8, False)}</title><style>p{{}}</style></head><body>{inner}{'</body></html>' if r.random() < 0.9 else ''}"


def labelled_pages(n: int, seed: int = 0) -> Iterator[tuple[str, set[str]]]:
    """n pages and, of each, the texts that are content."""
    for k in range(n):
        p = _Page(seed * 1_000_003 + k)
        yield p.page(), p.kept
