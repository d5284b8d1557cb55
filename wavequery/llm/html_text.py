"""Main text of web pages by composite text density.

Every block of the page's tree gets the density of its characters per tag, lowered by its share of linked
text. A block's sum is that of its children's densities; the block with the largest sum holds the
article. The least density on the path from the body to it is the threshold: of every block that reaches it, the subtree
with the largest sum is text. If the article's block lies in an ``article`` or ``main`` element, that element
is taken, and only such elements are searched for more, all of them: a block need not be denser than the least dense one of the article there.
Lists of links below the threshold are left out. Elements that never hold the article are left out by their tag; forms and elements with a role or
class of that kind too, unless they hold the article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head script style noscript template nav footer aside button select option textarea input iframe object embed "
    "svg canvas audio video map menu dialog title noembed noframes".split()
)
CLOSED_BY = {  # an open element ends where one of these begins
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
HOLDS = frozenset("html body div article main section table tr td th ul ol li dl dd blockquote".split())  # a p ends at most here
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert "
    "comment comments disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social "
    "related recommended newsletter subscribe subscription popup modal overlay toolbar pagination pager widget "
    "responses replies".split()
)
COMMENTS = frozenset("comment comments disqus responses replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())

FEW_LINKS = 5  # of a list that belongs to the paragraph before it

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_RAW_END = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")  # camelCase counts as several words
_BARRIERS = HOLDS | CLOSED_BY.keys() | {"p"}


class Block:
    """An element that counts: a block, or a link."""

    __slots__ = (
        "aside", "chars", "children", "density", "dropped", "follows", "linked", "links", "parent", "parts", "peak", "remarks", "sum", "tag", "tags"
    )

    def __init__(self, tag: str, parent: Block | None, dropped: bool, aside: bool = False, remarks: bool = False):
        self.tag, self.parent, self.dropped, self.aside = tag, parent, dropped, aside
        self.remarks = remarks  # set aside as reader comments
        self.follows = False  # stands behind a paragraph
        self.children: list[Block] = []
        self.parts: list[str | Block] = []  # text and blocks, in page order
        self.chars = self.tags = self.linked = self.links = 0
        self.density = self.sum = 0.0
        self.peak = self


def _set_aside(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element never holds text, whether it is set aside unless it holds the article, and whether as comments."""
    if tag in NEVER or tag == "header" and not inside:
        return True, False, False
    aside = tag == "form"
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, aside, False
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, False, False
    words = {w.lower() for w in _PART.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    named = found.get("role", "").lower() in ROLES or not ASIDE.isdisjoint(words)
    return False, aside or named, not COMMENTS.isdisjoint(words)


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, tag, whether it is an end tag, and attributes; tags are empty for comments and declarations.

    Each character is looked at a bounded number of times: behind the last ``>`` nothing is a tag, and once the quotes of a
    tag do not close, quotes count no longer. The receiver may send the place to go on from.
    """
    last, at, quotes = page.rfind(">"), 0, True
    while 0 <= (begin := page.find("<", at)):
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
            yield begin, at, "", False, ""
            continue
        if begin > last:
            return
        if page.startswith(("<!", "<?"), begin):
            at = page.find(">", begin) + 1
            yield begin, at, "", False, ""
            continue
        name = _NAME.match(page, begin)
        if not name:
            at = begin + 1
            continue
        rest = _QUOTED.match(page, name.end()) if quotes else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            quotes = False
            at = page.find(">", name.end()) + 1
            if not at:
                return
            attributes = page[name.end() : at - 1]
        further = yield begin, at, name[2].lower(), name[1] == "/", attributes
        if further is not None:
            at = further


class _Open:
    """The open elements, with what must be known about them without looking through all."""

    def __init__(self, root: Block):
        self.items = [("#page", root)]
        self.depths: dict[str, list[int]] = {}  # of the open elements of each name
        self.blocks = [0]  # elements up to each depth that are not inline
        self.barriers: list[int] = []  # depths of elements that end, or keep, what is implied

    def push(self, tag: str, block: Block) -> None:
        depth = len(self.items)
        self.items.append((tag, block))
        self.depths.setdefault(tag, []).append(depth)
        self.blocks.append(self.blocks[-1] + (tag not in INLINE))
        if tag in _BARRIERS:
            self.barriers.append(depth)

    def cut(self, depth: int) -> None:
        """Close everything from ``depth`` on."""
        while len(self.items) > depth:
            tag, _ = self.items.pop()
            self.depths[tag].pop()
            self.blocks.pop()
        while self.barriers and self.barriers[-1] >= depth:
            self.barriers.pop()

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element does not reach over blocks."""
        held = self.depths.get(tag)
        if held and not (tag in INLINE and self.blocks[-1] > self.blocks[held[-1]]):
            self.cut(held[-1])

    def imply(self, tag: str) -> None:
        """Close what a block start tag ends: a paragraph, and items of the same kind."""
        if self.barriers:
            depth = self.barriers[-1]
            name = self.items[depth][0]
            if name == "p" or tag in CLOSED_BY.get(name, ()):
                self.cut(depth)

    def within(self, *tags: str) -> bool:
        return any(self.depths.get(t) for t in tags)


def tree(page: str) -> list[Block]:
    """The blocks of a page, parents before children, also those that are set aside; the first is the page."""
    root = Block("#page", None, False)
    blocks, open_, at = [root], _Open(root), 0

    def text(data: str) -> None:
        block = open_.items[-1][1]
        if data and not block.dropped:
            block.parts.append(data)

    tokens, further = _tokens(page), None
    while True:
        try:
            begin, end, tag, closing, attributes = tokens.send(further)
        except StopIteration:
            break
        further = None
        text(page[at:begin])
        at = end
        if not tag:
            continue
        if closing:
            open_.end(tag)
            continue
        if tag in VOID:
            text(" ")
            continue
        if tag not in INLINE:
            open_.imply(tag)
        parent = open_.items[-1][1]
        if tag in INLINE and tag != "a":
            never, *aside = _set_aside(tag, attributes, True) if attributes else (False, False, False)
            block = Block(tag, parent, parent.dropped or never, *aside) if never or aside[0] else parent
        else:
            never, *aside = _set_aside(tag, attributes, open_.within("article", "main"))
            block = Block(tag, parent, parent.dropped or never, *aside)
        if block is not parent and not block.dropped:
            before = parent.children[-1] if parent.children else None
            block.follows = before is not None and (before.tag == "p" or before.aside and before.follows)
            parent.children.append(block)
            parent.parts.append(block)
            blocks.append(block)
        if tag in RAW:  # nothing in it is a tag but its own end
            close = _RAW_END[tag].search(page, at)
            at = further = close.end() if close else len(page)
        elif not attributes.endswith("/"):
            open_.push(tag, block)
    text(page[at:])
    return blocks


def without_asides(blocks: list[Block]) -> list[Block]:
    """The blocks that count, in ``blocks`` from ``tree``; what is set aside is taken out of its parent.

    A block that is set aside by its name, its role or as a form counts all the same if it holds the block with the
    largest sum or most of the page's plain text: it is a wrapper then. It is none if an ``article`` or ``main`` element has plain
    text besides; comments are none if a paragraph has.
    """
    if not any(b.aside for b in blocks):
        return blocks
    weigh(blocks)
    path, block = set(), blocks[0].peak
    while block is not None:
        path.add(id(block))
        block = block.parent
    above: dict[int, Block | None] = {}  # the nearest block set aside that holds a block, or is it
    for block in blocks:
        above[id(block)] = block if block.aside or block.parent is None else above[id(block.parent)]
    free: dict[int, int] = {}  # plain text below, without what is set aside there
    besides: set[int] = set()  # the nearest blocks set aside around an article or main with plain text
    prose: set[int] = set()  # those around a paragraph with plain text
    for block in reversed(blocks):
        below = sum(free[id(c)] for c in block.children if not c.aside)
        free[id(block)] = 0 if block.tag == "a" else block.chars - sum(c.chars for c in block.children) + below
        if free[id(block)] and block.tag in ("article", "main", "p"):
            (prose if block.tag == "p" else besides).add(id(above[id(block)]))
    total = blocks[0].chars - blocks[0].linked
    out: set[int] = set()
    changed: dict[int, Block] = {}
    for block in blocks:
        if block.parent is None:
            continue
        if id(block.parent) in out:
            out.add(id(block))
        elif block.aside:
            plain, near = block.chars - block.linked, id(above[id(block.parent)])
            apart = near in besides or block.remarks and near in prose
            if apart or not (id(block) in path or 2 * plain > total):
                out.add(id(block))
                changed[id(block.parent)] = block.parent
    for block in changed.values():
        block.children = [c for c in block.children if id(c) not in out]
        block.parts = [p for p in block.parts if isinstance(p, str) or id(p) not in out]
    return [b for b in blocks if id(b) not in out]


def _density(chars: int, tags: int, linked: int, links: int, share: float) -> float:
    if not chars:
        return 0.0
    base = math.log(chars * linked / max(chars - linked, 1) + share * chars + math.e)
    value = math.log(max(chars / max(linked, 1) * max(tags, 1) / max(links, 1), 1)) / math.log(max(base, 1.1))
    return chars / max(tags, 1) * value


def weigh(blocks: list[Block]) -> None:
    """Set densities, sums and the block with the largest sum of every subtree."""
    for block in reversed(blocks):
        block.density, block.sum, block.peak = 0.0, 0.0, block
        own = sum(len("".join(p.split())) for p in block.parts if isinstance(p, str))
        block.chars = own + sum(c.chars for c in block.children)
        block.tags = sum(c.tags + 1 for c in block.children)
        block.linked = block.chars if block.tag == "a" else sum(c.linked for c in block.children)
        block.links = sum(c.links for c in block.children) + (block.tag == "a")
    share = blocks[0].linked / max(blocks[0].chars, 1)
    for block in reversed(blocks):
        block.density = _density(block.chars, block.tags, block.linked, block.links, share)
        block.sum = sum(c.density for c in block.children)
        for child in block.children:
            alone = not block.peak.sum and not child.peak.sum and 2 * child.chars > block.chars
            if child.peak.sum > block.peak.sum or alone:
                block.peak = child.peak


def _link_list(block: Block, threshold: float) -> bool:
    """Whether a block is a list of links; a short one that follows a paragraph, such as its sources, is not."""
    if not (block.density < threshold and block.links > 1 and 2 * block.linked > block.chars):
        return False
    return not (block.follows and block.links <= FEW_LINKS and block.tag in ("ul", "ol", "dl"))


def _lines(page: Block, taken: set[int], bounds: set[int], threshold: float, least: float) -> Iterator[str]:
    """Texts of the blocks taken, in page order; links run on in the text around them.

    Loose text beside the blocks of a block is a block without a tag, and taken if it reaches ``least``, as its block must. Lists of
    links that do not reach the threshold are left out.
    """
    share = page.linked / max(page.chars, 1)
    held: list[str] = []
    plain = links = linked = 0
    todo: list[tuple[str | Block | None, bool, bool, bool]] = [(page, False, not bounds, False)]  # part, taken, in bounds, in a link
    dense = [page]  # the blocks around

    def line(inside: bool, bound: bool) -> str:
        nonlocal plain, links, linked
        reaches = bound and (dense[-1].density >= least or dense[-1].tag in ("#page", "html"))
        take = inside or plain > 0 and reaches and _density(plain + linked, links, linked, links, share) >= least
        text = "".join(held) if take else ""
        held.clear()
        plain = links = linked = 0
        return text

    while todo:
        part, inside, bound, link = todo.pop()
        if part is None:
            yield line(inside, bound)
            dense.pop()
        elif isinstance(part, str):
            held.append(part)
            chars = len("".join(part.split()))
            plain, linked = plain + chars * (not link), linked + chars * link
        elif part.tag == "a" and id(part) not in taken:
            links += 1
            todo += [(p, inside, bound, True) for p in reversed(part.parts)]
        else:
            yield line(inside, bound)
            inside, bound = inside or id(part) in taken, bound or id(part) in bounds
            if inside and _link_list(part, threshold):
                continue
            dense.append(part)
            todo.append((None, inside, bound, link))
            todo += [(p, inside, bound, link) for p in reversed(part.parts)]


def extract(page: str) -> str:
    """The main text of one page; empty if there is none."""
    blocks = without_asides(tree(page))
    weigh(blocks)
    best = blocks[0].peak
    if best.tag in ("#page", "html", "body"):  # an article is there, however short
        held = [b for b in blocks if b.tag in ("article", "main") and b.chars > b.linked]
        best = max(held, key=lambda b: b.chars - b.linked, default=best)
        best = best.peak if best.peak.sum else best
    path, holder = [], None
    block: Block | None = best
    while block is not None:
        path.append(block)
        if block.tag in ("article", "main"):
            holder = holder or block
        block = block.parent
    threshold = min((b.density for b in path if b.tag not in ("#page", "html")), default=0.0)
    bounds: set[int] = set()
    if holder:  # articles beside this one, or in the same main element
        mains = [b for b in path if b.tag == "main"]
        around = mains[-1] if mains else holder.parent
        near = [around, *around.children] if mains else around.children
        bounds = {id(holder), *(id(b) for b in near if b.tag in ("article", "main"))}
    within = set(bounds)
    for block in blocks:  # parents first
        if block.parent is not None and id(block.parent) in within:
            within.add(id(block))
    least, taken = threshold, {id(best)}
    if holder:  # what the article's own blocks have is enough for others
        taken.add(id(holder))
        least = min([least, *(c.density for c in best.children if c.density and not _link_list(c, threshold))])
    for block in blocks:
        fits = block.chars and block.density >= least and not _link_list(block, threshold) and block.tag not in ("#page", "html", "body", "a")
        if fits and (not holder or id(block) in within):
            taken.add(id(block.peak))
    plain = (" ".join(html.unescape(line).split()) for line in _lines(blocks[0], taken, bounds, threshold, least))
    return "\n\n".join(line for line in plain if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(page or "") for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page.

    White space in a block becomes one space, and blocks are joined by an empty line. Null and empty pages, and pages without
    text, give an empty text. Null ids and urls stay null; repeated rows are extracted each. An empty table gives no
    rows. Other columns are ignored.
    """
    columns = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in columns.schema}
    return columns.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
