"""Labelled pages for the block classifier, made by rule from a seed: html, and the texts of its main blocks.

Layouts vary in what a site does: semantic tags or divisions, telling names, names
that say nothing, or none, wrappers around all or parts, end tags left out, bylines and headers inside the article, notices and adverts before or inside the article, comments
inside or after it. Texts are invented words.
"""

from __future__ import annotations

import random

_SOUNDS = "ba be bi co da de di en er es fa ga ha il in ka la le lo ma me mi na ne no on or pa pe ra re ri ro sa se si ta te ti to un va ve vi".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, []
        self.divided = rng.random() < 0.08  # paragraphs are divisions

    def words(self, least: int, most: int) -> str:
        n = self.rng.randint(least, most)
        return " ".join("".join(self.rng.choice(_SOUNDS) for _ in range(self.rng.randint(1, 4))) for _ in range(n))

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.words(4, 16).capitalize() + self.rng.choice(("." * 5) + "?!") for _ in range(self.rng.randint(least, most)))

    def some(self, *options: str) -> str:
        return self.rng.choice(options)

    def name(self, *names: str) -> str:
        """A class or id, or nothing."""
        x = self.rng.random()
        return "" if x < 0.25 else f' {"class" if x < 0.75 else "id"}="{self.rng.choice(names)}"'

    def blank_name(self) -> str:
        """A class or id that says nothing, or none."""
        x = self.rng.random()
        made = self.some("x", "css-", "c", "sc-", "_", "wrap", "row", "col-md-", "box", "inner", "container", "layout") + self.some("", str(self.rng.randrange(99)), "".join(self.rng.choice("abcdefghknpqrstuvwxyz0123456789") for _ in range(6)))
        return "" if x < 0.3 else f' {"class" if x < 0.8 else "id"}="{made}"'

    def wrapped(self, inside: str) -> str:
        for _ in range(self.rng.choice((0, 0, 0, 1, 2))):
            tag = self.some("div", "div", "section")
            inside = f"<{tag}{self.blank_name()}>{inside}</{tag}>"
        return inside

    def keep(self, text: str) -> str:
        self.main.append(" ".join(text.split()))
        return text

    def menu(self) -> str:
        items = [self.words(1, 3) for _ in range(self.rng.randint(3, 10))]
        if self.rng.random() < 0.7:
            body = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in items) + "</ul>"
        else:
            body = "".join(f'<a href="/{x}">{x}</a> ' for x in items)
        tag = self.some("nav", "nav", "nav", "div")
        return f"<{tag}{self.name('menu', 'main-nav', 'navbar', 'top-menu', 'breadcrumbs') if tag == 'nav' else ' class=' + chr(34) + self.some('menu', 'navbar', 'topNav') + chr(34)}>{body}</{tag}>"

    def advert(self) -> str:
        name = self.some("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner-ad")
        inside = self.sentences(1, 3) if self.rng.random() < 0.7 else f'<a href="/x">{self.words(2, 8)}</a>'
        tag = self.some("div", "div", "div", "aside", "section", "p")
        return f'<{tag} {self.some("class", "id")}="{name}">{inside}</{tag}>'

    def notice(self) -> str:
        name = self.some("cookie-notice", "consent", "gdpr-banner", "newsletter", "alert", "paywall", "notice")
        tag = self.some("div", "div", "div", "section", "aside")
        return f'<{tag} {self.some("class", "id")}="{name}"><p>{self.sentences(1, 3)}</p>{self.some("", "<button>" + self.words(1, 2) + "</button>")}</{tag}>'

    def form(self) -> str:
        return f'<form action="/s"{self.name("search", "login-form", "signup")}><label>{self.words(1, 4)}</label><input name="q">{self.some("", "<p>" + self.sentences(1, 2) + "</p>")}<button>{self.words(1, 2)}</button></form>'

    def header(self) -> str:
        return f"<header{self.name('site-header', 'masthead', 'top')}><div>{self.words(1, 4)}</div>{self.some('', '<p>' + self.words(3, 9) + '</p>', self.menu())}</header>"

    def footer(self) -> str:
        inside = self.some(f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>&copy; 2020 {self.words(2, 6)}</p><p>{self.sentences(1, 3)}</p>", self.menu())
        if self.rng.random() < 0.15:
            return f"<p>{self.some('<small>', '<font size=1>', '')}{self.some('&copy; 2019', 'Copyright 2004', 'All rights reserved')} {self.words(1, 5)}"
        tag = self.some("footer", "footer", "footer", "div")
        return f"<{tag}{self.name('footer', 'site-footer', 'colophon') if tag == 'footer' else ' class=' + chr(34) + 'footer' + chr(34)}>{inside}</{tag}>"

    def sidebar(self) -> str:
        inside = f"<h3>{self.words(1, 4)}</h3>" + self.some("<ul>" + "".join(f"<li><a href='/r'>{self.words(3, 9)}</a></li>" for _ in range(self.rng.randint(2, 6))) + "</ul>", "".join(f"<p>{self.sentences(1, 3)}</p>" for _ in range(self.rng.randint(1, 3))))
        tag = self.some("aside", "aside", "div")
        return f"<{tag}{self.name('sidebar', 'widget', 'related', 'side-rail') if tag == 'aside' else ' class=' + chr(34) + self.some('sidebar', 'related', 'widget') + chr(34)}>{inside}</{tag}>"

    def comments(self) -> str:
        name = self.some("comments", "comment-list", "responses", "discussion", "reader-comments")
        tag = self.some("section", "div", "div", "ol", "ul")
        item = "li" if tag in ("ol", "ul") else self.some("div", "article", "p")
        inside = "".join(f'<{item}{self.some("", " class=" + chr(34) + "comment" + chr(34))}>{self.some("", "<b>" + self.words(1, 2) + "</b> ")}{self.sentences(1, 5)}</{item}>' for _ in range(self.rng.randint(1, 6)))
        heading = f"<h3>{self.words(1, 3)}</h3>" if tag in ("section", "div") else ""
        return f'<{tag} {self.some("class", "id")}="{name}">{heading}{inside}</{tag}>'

    def paragraph(self, end: bool) -> str:
        x = self.rng.random()
        text = self.sentences(1, 8) if x < 0.8 else self.words(1, 12) + self.some("", ".", ":")
        if self.rng.random() < 0.02:  # articles, too, speak of rights and subscriptions
            text = self.some("All rights reserved.", "Sign up for the newsletter.", f"Advertisement {text}", f"Copyright {text}", "Share this story.", f"Read more: {text}")
        self.keep(text)
        if x > 0.9:
            a, _, b = text.partition(" ")
            text = f"{a} <b>{b}</b>" if b else a
        if x < 0.08:
            return f"<p><b>{text}<br>"
        if self.divided:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>" if end else f"<p>{text}"

    def article(self) -> str:
        end, out, top = self.rng.random() < 0.85, [], []
        if self.rng.random() < 0.9:
            top.append(f"<h1>{self.keep(self.words(2, 10).capitalize())}</h1>")
        if self.rng.random() < 0.15:
            tag = self.some("p", "div")
            top.append(f"<{tag}{self.some('', self.blank_name(), ' class=' + chr(34) + self.some('byline', 'author', 'dek') + chr(34))}>{self.keep(self.words(2, 8))}</{tag}>")
        heading = "".join(top)
        out.append(f"<header>{heading}</header>" if top and self.rng.random() < 0.12 else heading)
        for _ in range(self.rng.choice((1, 2, 3, 5, 8, 13))):
            x = self.rng.random()
            if x < 0.72:
                out.append(self.paragraph(end))
            elif x < 0.78:
                tag = self.some("h2", "h2", "h3", "h4")
                out.append(f"<{tag}>{self.keep(self.words(1, 7).capitalize())}</{tag}>")
            elif x < 0.83:
                items = "".join(f"<li>{self.keep(self.words(3, 20))}</li>" for _ in range(self.rng.randint(2, 5)))
                tag = self.some("ul", "ul", "ol")
                out.append(f"<{tag}>{items}</{tag}>")
            elif x < 0.86:
                out.append(f"<blockquote>{self.keep(self.sentences(1, 3))}</blockquote>")
            elif x < 0.88:
                cells = "".join(f"<tr><td>{self.keep(self.words(2, 5))}</td><td>{self.keep(self.words(2, 5))}</td></tr>" for _ in range(2))
                out.append(f"<table>{cells}</table>")
            elif x < 0.90:
                out.append(f"<pre>{self.keep(self.words(5, 30))}</pre>")
            elif x < 0.93:
                out.append(self.advert())
            elif x < 0.955:
                out.append(self.sidebar())
            elif x < 0.975:
                out.append(self.notice())
            elif x < 0.983:
                out.append(self.form())
            else:
                out.append(f'<div class="{self.some("share", "social-share")}"><a href="#">{self.words(1, 2)}</a> <a href="#">{self.words(1, 2)}</a></div>')
        if self.rng.random() < 0.15:
            out.append(self.comments())
        way = self.rng.random()
        body = self.wrapped("".join(out))
        if way < 0.4:
            return f"<article{self.name('post', 'entry', 'story')}>{body}</article>"
        if way < 0.52:
            return f"<main{self.name('content', 'main')}><article>{body}</article></main>"
        if way < 0.6:
            return f"<main>{body}</main>"
        if way < 0.78:
            return f'<div {self.some("class", "id")}="{self.some("content", "post-content", "entry", "articleBody", "main", "story")}">{body}</div>'
        if way < 0.95:
            return f"<div{self.blank_name()}>{body}</div>"
        if "<table>" in body or not end:
            return body
        side = "<br>".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.rng.randrange(2, 6)))
        return f"<table><tr>{self.some('', '<td>' + side + '</td>')}<td>{body}</td></tr></table>"

    def html(self) -> str:
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        before = [f() for f, p in ((self.header, 0.35), (self.menu, 0.75), (self.notice, 0.3), (self.form, 0.2), (self.advert, 0.5)) if self.rng.random() < p]
        article = self.wrapped(self.article())
        after = [f() for f, p in ((self.comments, 0.3), (self.sidebar, 0.35), (self.advert, 0.25), (self.form, 0.15), (self.notice, 0.15), (self.footer, 0.85)) if self.rng.random() < p]
        return head + self.wrapped("".join(before) + article + "".join(after)) + "</body></html>"


def labelled_pages(n: int = 600, seed: int = 3) -> list[tuple[str, list[str]]]:
    """`n` pages with the texts of their main blocks, in order."""
    out = []
    for i in range(n):
        page = _Page(random.Random(f"{seed}/{i}"))
        out.append((page.html(), page.main))
    return out
