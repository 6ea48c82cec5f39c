"""Leaf blocks of a page: the text between block-level tags, with its open elements."""

from __future__ import annotations

import html
import re

# Element kinds of HTML.
VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
])
BLOCK = frozenset([
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "title", "tr", "ul",
])
#: Elements that end an open one of the same family, up to an element that holds the family.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: A start tag's attributes; the tag ends its element at once if the slash before ``>`` isn't part of a bare value.
_ATTRIBUTES = r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?"
#: Elements whose content is no markup, up to their end tag or the end of the page.
RAW = rf"<(script|style|iframe|textarea)(?:/>|{_ATTRIBUTES}(?:(?<=[\s\"'])/>|>(?:.*?</\1\s*>|.*\Z)))"
#: Elements that are left out where they have an end tag.
ASIDE = re.compile(rf"<!--.*?(?:-->|\Z)|{RAW}|<(/?)(noscript|template|svg|select|object)(?:(/)>|{_ATTRIBUTES}(?:((?<=[\s\"'])/)>|>))", re.I | re.S)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|{RAW}"
    r"|<(/?)([a-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-z][\w:-]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z",
    re.I | re.S,
)
MARKS = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\bhidden\b|display:\s*none", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marks(attributes: str) -> tuple[str, ...]:
    """The words in an element's class, id and role."""
    if "=" not in attributes and "hidden" not in attributes:
        return ()
    out = []
    for m in MARKS.finditer(attributes):
        value = m[2] or m[3] or m[4]
        out += [p.lower() for p in PIECE.findall(value)] if m[1] else ["hidden"]
    return tuple(dict.fromkeys(out))


def asides(page: str) -> dict[int, int]:
    """Start -> end of the elements left out. Each end tag goes with the last open one of its name; one without an end tag is a plain tag."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in ASIDE.finditer(page):
        if not m[3]:
            continue
        of = opened.setdefault(m[3].lower(), [])
        if m[2]:
            if of:
                out[of.pop()] = m.end()
        elif m[4] or m[5]:
            out[m.start()] = m.end()
        else:
            of.append(m.start())
    return out


class Block:
    __slots__ = ("text", "path", "links")

    def __init__(self, text: str, path: tuple, links: int):
        self.text, self.path, self.links = text, path, links


def blocks(page: str | None) -> list[Block]:
    """Blocks in page order; character references decoded, white space made one space. ``path``: open elements as (tag, marks)."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    path: tuple = ()
    links = 0

    def flush():
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, path, links))
            pieces.clear()
        links = 0

    def add(chunk: str):
        nonlocal path, links
        if "&" in chunk:
            chunk = html.unescape(chunk)
        if not chunk.isspace():
            if not any(not p.isspace() for p in pieces):
                path = tuple(stack)
            if any(tag == "a" for tag, _ in stack):
                links += len(chunk.strip())
        pieces.append(chunk)

    def pop_to(names: set[str], until: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    page = page or ""
    at = 0
    skip = asides(page)
    for m in TOKEN.finditer(page):
        if m.start() < at:  # within an element left out
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = skip.get(m.start(), m.end())
        if m.start() in skip:
            continue
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            pop_to({tag}, frozenset())
            continue
        if tag in BLOCK:
            pop_to({"p"}, BLOCK - {"p"})
            if tag in CLOSES:
                pop_to(*CLOSES[tag])
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, marks(attributes)))
    if at < len(page):
        add(page[at:])
    flush()
    return out
