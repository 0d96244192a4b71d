"""HTML as flat text blocks: what op 11 classifies. Plain Python, run on one page at a time.

Block-level tags end a block, <br> is white space, other tags leave no trace. Character references are
decoded once. Comments, scripts, styles, forms' fields and the head hold no text. Unclosed tags close
with their parents; a tag that never ends is text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

#: Elements whose whole content isn't text of the page.
_MUTE = "script|style|noscript|template|svg|iframe|object|canvas|head|select|textarea|button|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_MUTE})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[a-z!?/][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_CONTAINERS = "address article aside body center dialog div dl fieldset footer form header hgroup html main menu nav ol section table tbody tfoot thead tr ul details".split()
_LEAVES = "blockquote caption dd dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li p pre summary td th".split()
_BLOCKS = frozenset(_CONTAINERS + _LEAVES)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the left closes an open one of the right, unless one of _CONTAINERS is between.
_CLOSES = {t: "p" for t in _BLOCKS} | {"li": "p li", "dd": "p dd dt", "dt": "p dd dt", "td": "p td th", "th": "p td th"}

_OFF_TAGS = frozenset("nav footer aside form menu dialog".split())
_OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_OFF = frozenset(
    "ad ads advert advertisement adsense adslot aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer"
    " gdpr login menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup promo"
    " promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " taboola toolbar topbar widget widgets".split()
)
_ON = frozenset("article content entry main post story".split())
_HEADER = frozenset("header masthead".split())


class Block(NamedTuple):
    text: str
    words: int
    #: Letters of the text, and those inside links, without blanks.
    letters: int
    linked: int
    #: Unlinked words of all blocks of the same container; an article is one container.
    family: int
    #: In a container that its tag or name makes no part of the article; in one that it makes part.
    off: bool
    on: bool
    heading: bool


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """off, on, header by the tag's name, class, id and role."""
    words, roles, hidden, body = set(), set(), False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words |= {w.lower() for w in _WORD.findall(value)}
        elif name == "role":
            roles |= set(value.lower().split())
        elif name == "itemprop":
            body |= value.lower() == "articlebody"
        else:
            hidden |= name == "hidden" or "display:none" in value.lower().replace(" ", "")
    if tag in ("html", "body"):
        return False, False, False
    off = hidden or tag in _OFF_TAGS or bool(words & _OFF or roles & _OFF_ROLES)
    on = body or tag in ("article", "main") or bool(words & _ON or roles & {"main", "article"})
    return off, on and not off, not on and (tag == "header" or bool(words & _HEADER))


class _Page:
    def __init__(self) -> None:
        self.stack: list[int] = []
        # For each block-level element: tag, parent, off, on, header.
        self.elements: list[tuple[str, int, bool, bool, bool]] = []
        self.void: set[int] = set()
        self.main = False
        self.blocks: list[tuple[str, int, int, int]] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.link_at: int | None = None

    def text(self, raw: str) -> None:
        piece = unescape(raw)
        self.pieces.append(piece)
        if self.link_at is not None:
            self.linked += len("".join(piece.split()))

    def end_block(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            self.blocks.append((" ".join(words), len(words), self.linked, self.stack[-1] if self.stack else -1))
        self.pieces, self.linked = [], 0

    def close(self, down_to: int) -> None:
        del self.stack[down_to:]
        if self.link_at is not None and self.link_at > down_to:
            self.link_at = None

    def open(self, tag: str, attributes: str) -> None:
        closed = _CLOSES[tag].split()
        for k in range(len(self.stack) - 1, -1, -1):
            held = self.elements[self.stack[k]][0]
            if held in closed:
                self.close(k)
            elif held in _CONTAINERS:
                break
        off, on, header = _kind(tag, attributes)
        if tag in ("article", "main") and on and not self.main:
            # What holds the article is no menu or form, whatever its name.
            self.main = True
            self.void.update(self.stack)
        self.elements.append((tag, self.stack[-1] if self.stack else -1, off, on, header))
        if tag != "hr":
            self.stack.append(len(self.elements) - 1)

    def tag(self, end: bool, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link_at = None if end else len(self.stack)
        elif tag == "br":
            self.pieces.append(" ")
        elif tag in _BLOCKS:
            self.end_block()
            if not end:
                self.open(tag, attributes)
            else:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.elements[self.stack[k]][0] == tag:
                        self.close(k)
                        break

    def finish(self) -> list[Block]:
        self.end_block()
        off, on, home = [], [], []
        for k, (tag, parent, is_off, is_on, header) in enumerate(self.elements):
            above = parent >= 0
            on.append(is_on or (above and on[parent]))
            gone = (is_off or (header and not (above and on[parent]))) and k not in self.void
            off.append(gone or (above and off[parent]))
            inner = above and (tag in _LEAVES or (on[parent] and off[k] == off[parent]))
            home.append(home[parent] if inner else k)
        family: dict[int, int] = {}
        for text, words, linked, at in self.blocks:
            letters = len(text) - words + 1
            where = home[at] if at >= 0 else -1
            family[where] = family.get(where, 0) + (words if 3 * linked < letters else 0)
        return [
            Block(text, words, len(text) - words + 1, linked, family[home[at] if at >= 0 else -1], at >= 0 and off[at], at >= 0 and on[at], at >= 0 and self.elements[at][0] in _HEADINGS)
            for text, words, linked, at in self.blocks
        ]


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in their order."""
    page, at = _Page(), 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            page.text(html[at : token.start()])
        at = token.end()
        if token[3]:
            page.tag(bool(token[2]), token[3].lower(), token[4])
        elif token[1]:
            page.pieces.append(" ")
    page.text(html[at:])
    return page.finish()
