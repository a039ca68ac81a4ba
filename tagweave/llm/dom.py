"""Pages as boxes and pieces of text, read in one pass over the markup."""

from __future__ import annotations

import re
from collections.abc import Container, Iterable
from dataclasses import dataclass, field
from html.parser import HTMLParser

from xxhash import xxh64_intdigest

# Elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a new one of the same group ends, up to the element that holds the group.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
NOT_TEXT = frozenset(
    "script style noscript template head title iframe object svg canvas form button select textarea "
    "nav footer aside dialog menu".split()
)
NOT_TEXT_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification popup modal overlay newsletter subscribe signup login sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination footer comment comments disqus replies share sharing "
    "social related recommended widget toolbar".split()
)
#: Only outside an article; inside it they may hold its title.
NOT_TEXT_OUTSIDE, NOT_TEXT_NAMES_OUTSIDE = frozenset(["header"]), frozenset(["header", "masthead"])
NOT_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split()
)
#: Elements that are the page or its text as a whole.
WHOLE = frozenset("html body article main".split())
#: Words of a window by which texts of a box are compared.
WINDOW = 3
_NAME = re.compile(r"[a-z0-9]+")


def _hash(*parts: object) -> int:
    return xxh64_intdigest("\x1f".join(map(str, parts)))


def _end(html: str) -> int:
    """Where a page ends, without a tag that is cut off."""
    last = html.rfind("<")
    cut_off = last >= 0 and html.find(">", last) < 0 and re.match(r"[A-Za-z/!?]", html[last + 1 : last + 2])
    return last if cut_off else len(html)


@dataclass
class Element:
    tag: str
    branch: int  # names the labels from the root to here
    noise: bool
    article: bool  # is or lies in an article
    main: bool
    box: int  # the nearest box, from here upwards, that may belong to the site; -1 if there is none
    own: bool = False  # is that box itself
    parts: list[int] = field(default_factory=list)  # hashes of texts and children
    kinds: list[str] = field(default_factory=list)  # labels of children, runs of equal ones once


@dataclass
class Box:
    """All elements of a page on one branch."""

    branch: int
    content: set[int] = field(default_factory=set)  # hashes of word windows and of what links lead to
    layout: int = 0  # the sequences of children, whatever their order
    inner: bool = False  # has children


class Page(HTMLParser):
    """Reads a page; afterwards ``boxes`` and ``pieces`` hold what it has.

    A piece is a run of text with its box (-1 for none), the number of its block, and whether it lies in
    an article or in a main element. Text of elements that never hold any, or declare to be
    menus, notices and the like, is no piece. Boxes are block elements, and others with a name of
    their own, that a site may repeat; what makes up an article is none, but a named box in it is.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", 0, False, False, False, -1)]
        self.boxes: list[Box] = []
        self.pieces: list[tuple[str, int, int, bool, bool]] = []
        self.has_article = self.has_main = False
        self.article_parts: list[int] = []
        self._known: dict[int, int] = {}
        self._block = 0
        self._words: dict[int, list[str]] = {}
        self.feed(html[: _end(html)])
        self.close()
        while len(self.stack) > 1:
            self._pop()
        self._end_block()
        self.whole = _hash(*self.stack[0].parts)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self._end_block()
            elif tag == "br":
                self._add(" ")
            elif tag == "img":
                self._link(dict(attrs).get("src"))
            return
        if tag in BLOCKS:
            self._end_block()
            self._end_inside(("p",), ("article", "div", "td", "th", "li", "section", "main", "table", "body"))
        if tag in SIBLINGS:
            self._end_inside(*SIBLINGS[tag])
        values = dict(attrs)
        self.stack.append(self._element(tag, values))
        if tag == "a":
            self._link(values.get("href"))

    def _element(self, tag: str, attrs: dict[str, str | None]) -> Element:
        parent = self.stack[-1]
        kind = " ".join(sorted(_NAME.findall((attrs.get("class") or "").lower())))
        own = (attrs.get("id") or "").lower()
        names = {*kind.split(), *_NAME.findall(own)}
        role = (attrs.get("role") or "").lower()
        noise = tag in NOT_TEXT or not names.isdisjoint(NOT_TEXT_NAMES) or role in NOT_TEXT_ROLES
        if not parent.article:
            noise = noise or tag in NOT_TEXT_OUTSIDE or not names.isdisjoint(NOT_TEXT_NAMES_OUTSIDE)
        noise = noise or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        if tag in WHOLE:
            noise = tag == "article" and not names.isdisjoint(NOT_TEXT_NAMES)
        noise = noise or parent.noise
        label = f"{tag}.{kind}"
        if not parent.kinds or parent.kinds[-1] != label:
            parent.kinds.append(label)
        branch = _hash(parent.branch, label)
        article = parent.article or tag == "article" and not noise
        main = parent.main or (tag == "main" or role == "main") and not noise
        self.has_article |= article
        self.has_main |= main
        # what makes up an article is text even where a site repeats it; boxes inside it may not be
        own = not noise and tag not in WHOLE and (bool(names) or tag in BLOCKS and not article)
        return Element(tag, branch, noise, article, main, self._box(branch) if own else parent.box, own)

    def _box(self, branch: int) -> int:
        at = self._known.setdefault(branch, len(self.boxes))
        if at == len(self.boxes):
            self.boxes.append(Box(branch))
        return at

    def _link(self, target: str | None) -> None:
        at = self.stack[-1]
        if target and at.box >= 0 and not at.noise:
            self.boxes[at.box].content.add(_hash("link", target))

    def _add(self, data: str) -> None:
        at = self.stack[-1]
        if not at.noise:
            self.pieces.append((data, at.box, self._block, at.article, at.main))
            if at.box >= 0:
                self._words.setdefault(at.box, []).append(data)

    def handle_endtag(self, tag: str) -> None:
        inline = tag not in BLOCKS
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if not inline:
                    self._end_block()
                while len(self.stack) > i:
                    self._pop()
                return
            if inline and self.stack[i].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        at = self.stack[-1]
        if data.strip():
            at.parts.append(_hash(" ".join(data.split())))
        self._add(data)

    def _end_inside(self, tags: tuple[str, ...], holders: tuple[str, ...]) -> None:
        """End the nearest open element of these, unless a holder is nearer."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in holders:
                return

    def _pop(self) -> None:
        at = self.stack.pop()
        if at.tag in BLOCKS:
            self._end_block()
        whole = _hash(at.tag, *at.parts)
        self.stack[-1].parts.append(whole)
        if at.tag == "article" and not at.noise and not self.stack[-1].article:
            self.article_parts.append(whole)
        if at.own:
            box = self.boxes[at.box]
            box.inner |= bool(at.kinds)
            box.layout = (box.layout + _hash(*at.kinds)) % (1 << 63)

    def _end_block(self) -> None:
        """The next piece is of another block; windows of words do not reach over its border."""
        self._block += 1
        for box, texts in self._words.items():
            words = "".join(texts).split()
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                self.boxes[box].content.add(_hash(*words[i : i + WINDOW]))
        self._words = {}

    def identity(self) -> int:
        """The same for pages with the same article, or the same page where there is none."""
        return _hash(*self.article_parts) if self.article_parts else self.whole


def text_of(pieces: Iterable[tuple[str, int, int, bool, bool]], low: Container[int] = ()) -> str:
    """The blocks of the article; of the main element, or the whole page, where there is none.

    Pieces of the boxes ``low`` are left out.
    """
    pieces = list(pieces)
    place = 3 if any(piece[3] for piece in pieces) else 4 if any(piece[4] for piece in pieces) else None
    blocks: dict[int, list[str]] = {}
    for piece in pieces:
        if piece[1] not in low and (place is None or piece[place]):
            blocks.setdefault(piece[2], []).append(piece[0])
    texts = (" ".join("".join(block).split()) for block in blocks.values())
    return "\n".join(text for text in texts if text)
