"""Leaf blocks of a page: text between block boundaries, with the tags and names it stands under."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are never text of the page.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "template", "noscript", "xmp", "iframe")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes when it is open, and what that search does not leave.
_CLOSES_P = _BLOCKS - {"button", "caption", "label", "legend", "option", "optgroup", "select", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "html", "body"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Words of class, id and role names, by what they usually mark.
NAME_WORDS = {
    "ad": "ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored adsense adsbox adbox adunit adslot dfp outbrain taboola",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager topbar toolbar skip tabs contentinfo",
    "side": "sidebar side rail widget widgets aside complementary related recommended popular trending teaser",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead logo branding banner hero",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall toast warning announcement",
    "comment": "comment comments reply replies discussion disqus respond response responses feedback thread commentlist reader",
    "share": "share sharing social follow tweet facebook twitter",
    "form": "form login signin signup register search field input",
    "main": "article content post entry story main text prose body articlebody",
}
_MEANS = {w: k for k, words in NAME_WORDS.items() for w in words.split()}


class Block(NamedTuple):
    text: str
    #: what the block stands under, as features
    under: frozenset[str]
    tag: str
    #: characters inside links
    linked: int
    #: where it stands in a page that says where its article is: "inside", "outside"; "unsaid" in a page that doesn't
    place: str = "unsaid"


def _placed(found: list[Block]) -> list[Block]:
    """The blocks with their places: by article and main elements, else by names of main parts; comments may be articles, too."""
    for marks in ({"in:article", "in:main"}, {"name:main"}):
        inside = [bool(marks & b.under) and "name:comment" not in b.under for b in found]
        if any(inside):
            return [b._replace(place="inside" if x else "outside") for b, x in zip(found, inside)]
    return found


def _word_marks(attributes: str) -> set[str]:
    out = set()
    for m in _NAMES.finditer(attributes):
        for w in _PARTS.findall(m[1] or m[2] or m[3] or ""):
            if kind := _MEANS.get(w.lower()):
                out.add(f"name:{kind}")
    return out


def blocks(html: str) -> list[Block]:
    """The blocks with text, in page order; character references decoded, white space collapsed, ends trimmed."""
    out: list[Block] = []
    empty: frozenset[str] = frozenset()
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links, linked, tag = 0, 0, "body"

    def close() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append(Block(text, stack[-1][1] if stack else empty, stack[-1][0] if stack else "body", linked))
            parts.clear()
        linked = 0

    def pop_to(tags: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, n = 0, len(html)
    match = _TOKEN.match
    while at < n:
        m = match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if links:
                    linked += len(piece)
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if tag in _RAW and not ends:
            end = _RAW[tag].search(html, at)
            at = end.start() if end else n
            if tag == "iframe":
                close()
            continue
        if tag not in _BLOCKS:
            if tag == "a":
                links = 0 if ends else 1
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        links = 0 if tag not in ("li", "label") else links
        if ends:
            pop_to(set(_HEADINGS) if tag in _HEADINGS else {tag}, {"body"} if tag in ("p", "li") and not any(t == tag for t, _ in stack) else set())
            continue
        if tag in _CLOSES_P:
            pop_to({"p"}, {"button", "td", "th", "div", "section", "article", "main", "aside", "li", "blockquote", "form"})
        if tag in _CLOSES:
            pop_to(*_CLOSES[tag])
        if tag in _VOID:
            continue
        up = stack[-1][1] if stack else empty
        own = {f"in:{tag}"} | _word_marks(m[3] or m[6] or "") if (m[3] or m[6]) else {f"in:{tag}"}
        if tag in ("header", "footer", "aside", "nav", "form") and ("in:article" in up or "in:main" in up):
            own.add(f"in:article>{tag}")
        stack.append((tag, up | own))
    close()
    return _placed(out)
