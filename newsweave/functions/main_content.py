"""The main content of a web page, found in its tree of blocks.

Block elements become nodes, inline elements only text; so a tree stays small and tags that are never
closed can't swallow it.  Boilerplate elements and blocks whose class or id says so are cut off.
Each paragraph then gives points to the blocks around it, for its length and its commas, half as
many to the next block up and fewer above.  A block's own class and tag add to its points, and
its share of link text takes from them.  The best block is the content, together with
those of its siblings that have a fair share of its points or read like paragraphs.  A page where no
block has points gives all its text outside boilerplate.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Text here is never shown.
HIDDEN = frozenset({"script", "style", "noscript", "template", "svg", "head"})
#: Elements around or beside the content.
BOILERPLATE = frozenset({"nav", "footer", "aside", "form", "button", "select", "iframe", "menu", "dialog"})
BLOCKS = frozenset({
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "th", "thead", "tr", "ul",
}) | BOILERPLATE | HIDDEN
#: An opening tag ends an open one of these kinds.
ENDED_BY = {
    "p": BLOCKS - {"body", "html"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}),
}
PARAGRAPHS = frozenset({"p", "pre", "blockquote", "td", "li", "dd"})
TAG_POINTS = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 3.0, "pre": 3.0, "blockquote": 3.0, "td": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "header": -5.0, "th": -5.0}
_WORD = "(?:^|[^a-z])(?:{})s?(?:$|[^a-z])"
AGAINST = re.compile(_WORD.format("ad|advert|advertisement|banner|breadcrumb|comment|cookie|foot|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|pager|pagination|popup|promo|related|share|sharing|sidebar|social|sponsor|sponsored|subscribe|tag|toolbar|widget"))
IN_FAVOUR = re.compile(_WORD.format("article|body|blog|content|entry|hentry|main|page|post|story|text"))
LEAST_PARAGRAPH, CLASS_POINTS, SIBLING_SHARE, LEVELS = 25, 25.0, 0.2, 5


class Block:
    __slots__ = ("tag", "up", "parts", "cut", "text", "linked", "commas", "points", "hint", "blocks")

    def __init__(self, tag: str, up: Block | None, named: str):
        self.tag, self.up, self.parts = tag, up, []
        self.cut = tag in BOILERPLATE or tag in HIDDEN
        self.hint = CLASS_POINTS * bool(IN_FAVOUR.search(named)) - CLASS_POINTS * bool(AGAINST.search(named))
        if self.hint < 0 and tag not in ("body", "html", "article", "main"):
            self.cut = True
        self.text = self.linked = self.commas = self.blocks = 0
        self.points: float | None = None

    def density(self) -> float:
        return self.linked / self.text if self.text else 0.0

    def score(self) -> float:
        return (self.points or 0.0) * (1 - self.density())


class Page(HTMLParser):
    """Title, links and block tree of one page."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Block("html", None, "")
        self.scored: list[Block] = []
        self.links: list[tuple[str, str]] = []
        self.title, self._in_title, self._link, self._hidden, self._cut = "", False, None, 0, 0
        self.feed(page)
        self.close()
        while self.at is not None:
            self._leave()

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self._in_title = True
        elif tag == "a":
            found = dict(attrs)
            if found.get("href"):
                self._link = (found["href"], [])
        elif tag == "br":
            self.at.parts.append("\n")
        if tag not in BLOCKS or tag == "html":
            return
        while self.at.up is not None and tag in ENDED_BY.get(self.at.tag, ()):
            self._leave()
        found = dict(attrs)
        self.at = Block(tag, self.at, f"{found.get('class') or ''} {found.get('id') or ''}".lower())
        self._hidden += tag in HIDDEN
        self._cut += self.at.cut

    def handle_startendtag(self, tag, attrs):
        if tag == "br" or tag not in BLOCKS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        elif tag == "a" and self._link:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split())))
            self._link = None
        if tag not in BLOCKS:
            return
        open_block = self.at
        while open_block is not None and open_block.tag != tag:
            open_block = open_block.up
        if open_block is not None and open_block.up is not None:
            while self.at is not open_block:
                self._leave()
            self._leave()

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._hidden:
            self.at.parts.append(data)
            n = len(data) if not data.isspace() else 0
            self.at.text += n
            self.at.commas += data.count(",") + data.count("，") + data.count("、")
            if self._link:
                self._link[1].append(data)
                self.at.linked += n

    def _leave(self) -> None:
        block, up = self.at, self.at.up
        self.at = up
        self._hidden -= block.tag in HIDDEN
        self._cut -= block.cut
        if up is not None and not block.cut:
            if not self._cut and (block.tag in PARAGRAPHS or not block.blocks and block.tag in ("div", "section", "article")) and block.text >= LEAST_PARAGRAPH:
                self._give(block)
            up.parts.append(block)
            up.text, up.linked, up.commas, up.blocks = up.text + block.text, up.linked + block.linked, up.commas + block.commas, up.blocks + 1

    def _give(self, paragraph: Block) -> None:
        points = 1 + paragraph.commas + min(paragraph.text / 100, 3.0)
        block = paragraph.up if paragraph.tag in PARAGRAPHS else paragraph
        for level in range(LEVELS):
            if block is None:
                break
            if block.points is None:
                block.points = TAG_POINTS.get(block.tag, 0.0) + block.hint
                self.scored.append(block)
            block.points += points / (1 if level == 0 else 2 * level)
            block = block.up

    def content(self) -> list[Block]:
        """The best block among its siblings, in order."""
        best = max(self.scored, key=Block.score, default=None)
        if best is None or best.score() <= 0:
            return [self.root]
        if best.up is None:
            return [best]
        chosen = []
        for part in best.up.parts:
            if isinstance(part, Block) and (part is best or part.score() >= max(10.0, SIBLING_SHARE * best.score()) or reads_well(part)):
                chosen.append(part)
        return chosen


def reads_well(block: Block) -> bool:
    """A paragraph, or a heading, beside the content that isn't made of links."""
    if block.tag == "p":
        return block.text > 80 and block.density() < 0.25 or 0 < block.text <= 80 and not block.linked
    return block.tag in ("h1", "h2", "h3", "pre", "blockquote") and block.text > 0 and block.density() < 0.25


def lines(blocks: list[Block]) -> list[str]:
    """Text of the blocks, one line for each run of inline text."""
    pieces, stack = [], list(reversed(blocks))
    while stack:
        part = stack.pop()
        if isinstance(part, Block):
            pieces.append("\n")
            stack.append("\n")
            stack.extend(reversed(part.parts))
        else:
            pieces.append(part)
    found = (" ".join(x.split()) for x in "".join(pieces).split("\n"))
    return [x for x in found if x]
