"""Main text of web pages by composite text density.

A page becomes a DOM of its block elements; inline elements count as tags of the
block they are in. Scripts, styles, hidden elements, menus, footers, asides and the
like are left out, and so are blocks that name themselves headers, forms, notices,
adverts, comments and so on (by tag, role, class or id), unless they hold most of the
page's article: a name alone takes no text that the page consists of. Every block then
has characters C, tags T, linked characters LC and link tags LT of its subtree, and
the density

    C / T * log(C / LC * T / LT, base ln(C / (C - LC) * LC + LC_body / C_body * C + e))

(zeros count as 1), which links pull down. The block with the largest sum of its
children's densities is content. The least density on the way from it up to the
body is the threshold: other blocks that reach it add the largest-sum block of
their own subtrees. What lies between two pieces of content in one parent, and a
heading right before the first, belongs to it, unless most of it is linked. An article
element most of whose unlinked characters are content by then is content as a whole,
with its headings and lists of links.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's element kinds and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")
DROPPED = frozenset("head script style noscript template textarea iframe object embed svg canvas audio video button select option title".split())
ASIDE = frozenset("nav footer aside dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended comment comments disqus respond replies".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An open element (and all in it) ends where one of these begins inside the same parent.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th", "tbody"), "tbody": ("thead", "tr", "td", "th", "tbody"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
BORDERS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|/?([a-zA-Z][^\s/>]*)((?:[^>"']|=\s*"[^"]*"|=\s*'[^']*'|["'])*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


class Block:
    __slots__ = ("name", "parent", "items", "chars", "tags", "link_chars", "links", "density", "sum", "best", "declared")

    def __init__(self, name: str, parent: Block | None, declared: bool = False):
        #: declared: whether it names itself a part of the page that is no content.
        self.name, self.parent, self.declared = name, parent, declared
        self.items: list[Block | str] = []
        self.chars = self.link_chars = self.links = 0
        self.tags = 1

    def blocks(self) -> list[Block]:
        return [i for i in self.items if isinstance(i, Block)]


def hidden(name: str, attributes: str) -> bool:
    """Whether nothing of an element is to be read."""
    if name in DROPPED:
        return True
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def declared(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element names itself a part of the page that is no content, by tag or
    role, or by a whole class or id: all words of a hyphenated one, as in
    cookie-notice; has-sidebar, ad-free and social-science name none."""
    if name in ("body", "html", "article", "main"):
        return False
    if name in ASIDE or name in ("form", "fieldset") or (name == "header" and not inside):
        return True
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        tokens = value.strip("\"'").lower().split()
        if key.lower() == "role" and ROLES.intersection(tokens):
            return True
        if key.lower() in ("class", "id"):
            for token in tokens:
                words = _NAME.findall(token)
                if words and PARTS.issuperset(words):
                    return True
    return False


def parse(page: str) -> Block:
    """The tree of blocks without boilerplate; unclosed elements end with their parents."""
    body = Block("body", None)
    here = body
    #: Open elements: name, the block that was current outside, whether a link.
    stack: list[tuple[str, Block, bool]] = []
    skip = -1  # depth of the stack at which a left-out element began
    in_link = articles = 0
    at, size = 0, len(page)

    def text(piece: str) -> None:
        if skip >= 0 or not piece:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        here.items.append(piece)
        n = len("".join(piece.split()))
        here.chars += n
        if in_link:
            here.link_chars += n

    def close(depth: int) -> None:
        nonlocal here, skip, in_link, articles
        while len(stack) > depth:
            name, here, link = stack.pop()
            in_link -= link
            articles -= name == "article"
            if skip >= len(stack):
                skip = -1

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[1]
        if name is None:
            continue
        name = name.lower()
        if not page[at - 1 : at] == ">":
            break  # the page ends within a tag
        if page[m.start() + 1] == "/":
            if name == "br":
                text(" ")
            elif name == "p" and not any(s[0] == "p" for s in stack):
                text(" ")
            else:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        break
            continue
        if name in ("html", "body"):
            if stack and stack[0][0] == "head":
                close(0)
            continue
        if name in RAW:
            stop = _END[name].search(page, at)
            at = size if stop is None else page.find(">", stop.end()) + 1 or size
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if name in SIBLINGS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in BORDERS[name]:
                    break
                if stack[depth][0] in SIBLINGS[name]:
                    close(depth)
                    if name in ("li", "dt", "dd", "td", "th", "option"):
                        break
        if stack and stack[0][0] == "head" and name not in ("meta", "link", "base", "title"):
            close(0)
        if skip < 0:
            here.tags += name in INLINE or name in VOID
            here.links += name == "a"
        if name in VOID:
            text(" " if name in ("br", "hr") else "")
            continue
        outside, link = here, name == "a"
        if skip < 0 and hidden(name, m[2]):
            skip = len(stack)
            here.items.append(" ")
        elif skip < 0 and ((part := declared(name, m[2], articles > 0)) or name not in INLINE):
            block = Block(name, here, part)
            here.items.append(block)
            here = block
        stack.append((name, outside, link))
        in_link += link
        articles += name == "article"
    drop_declared(body)
    return body


def _ordered(body: Block) -> list[Block]:
    """All blocks, outer ones first."""
    order, todo = [], [body]
    while todo:
        block = todo.pop()
        order.append(block)
        todo += [i for i in block.items if isinstance(i, Block)]
    return order


def drop_declared(body: Block) -> None:
    """Leaves out declared blocks, but none that holds most of the unlinked characters of
    the page's article and main elements (of the page, where it has neither; a menu, a
    footer or an aside is left out even then). Inline ones that stay are again part of
    their block."""
    order = _ordered(body)
    if not any(block.declared for block in order):
        return
    plain: dict[int, int] = {}
    told: dict[int, int] = {}  # unlinked characters in article and main elements
    for block in reversed(order):
        inner = block.blocks()
        plain[id(block)] = block.chars - block.link_chars + sum(plain[id(i)] for i in inner)
        told[id(block)] = sum(plain[id(i)] if i.name in ("article", "main") else told[id(i)] for i in inner)
    whole = told[id(body)]
    stays = lambda i: 2 * told[id(i)] > whole if whole else i.name not in ASIDE and 2 * plain[id(i)] > plain[id(body)]
    for block in reversed(order):
        items: list[Block | str] = []
        for i in block.items:
            if not isinstance(i, Block) or not i.declared:
                items.append(i)
            elif not stays(i):
                items.append(" ")
            elif i.name not in INLINE:
                items.append(i)
            else:
                for j in i.items:
                    if isinstance(j, Block):
                        j.parent = block
                    items.append(j)
                block.chars, block.link_chars = block.chars + i.chars, block.link_chars + i.link_chars
                block.tags, block.links = block.tags + i.tags - 1, block.links + i.links
        block.items = items


def measure(body: Block) -> None:
    order = _ordered(body)
    for block in reversed(order):
        if block.parent is not None:
            for k in ("chars", "tags", "link_chars", "links"):
                setattr(block.parent, k, getattr(block.parent, k) + getattr(block, k))
    share = body.link_chars / max(body.chars, 1)
    for block in reversed(order):
        c, t, lc, lt = block.chars, block.tags, block.link_chars, block.links
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        block.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(math.log(base), 1e-9) if c and base > 1 else 0.0
        if base <= math.e ** 1e-3 or lc == 0:
            # no links: the base is e and its logarithm 1 where the body has none either
            block.density = c / t * math.log(max(c * t, 1.0)) / max(math.log(math.log(share * c + math.e)), 1.0) if c else 0.0
        inner = [i for i in block.items if isinstance(i, Block)]
        block.sum = sum(i.density for i in inner)
        block.best = block
        for i in inner:
            if i.best.sum > block.best.sum:
                block.best = i.best


def content(body: Block) -> dict[int, set[int]]:
    """What is content: of each block (by id) that has some itself, the places of its
    items that are."""
    measure(body)
    if not body.chars:
        return {}
    threshold = min(b.density for b in _up(body.best))
    order = _ordered(body)
    chosen = {id(b.best if b.best.sum > 0 else b) for b in order if b.density >= threshold}
    parts: dict[int, set[int]] = {}
    kept: dict[int, int] = {}  # unlinked characters of a block that are content
    plain = {id(b): b.chars - b.link_chars for b in order}
    for block in reversed(order):
        at = {i for i, x in enumerate(block.items) if isinstance(x, Block) and id(x) in chosen}
        if id(block) in chosen:
            kept[id(block)] = plain[id(block)]
            continue
        parts[id(block)] = at = _closed(block, at)
        kept[id(block)] = sum(plain[id(x)] if i in at else kept[id(x)] for i, x in enumerate(block.items) if isinstance(x, Block))
        if block.name == "article" and 2 * kept[id(block)] > plain[id(block)]:
            chosen.add(id(block))
            kept[id(block)] = plain[id(block)]
    if id(body) in chosen:
        parts[id(body)] = set(range(len(body.items)))
    return parts


def _closed(block: Block, at: set[int]) -> set[int]:
    """Places of a block's items that are content, if those `at` are: what lies between
    them too, and a heading before the first, unless most of it is linked."""
    if not at:
        return at
    own = lambda x: not isinstance(x, Block) or 2 * x.link_chars <= x.chars
    out = at | {i for i in range(min(at), max(at)) if own(block.items[i])}
    before = [i for i in range(min(at)) if isinstance(block.items[i], Block) and block.items[i].chars]
    if before and own(block.items[before[-1]]) and any(b.name in HEADINGS for b in _ordered(block.items[before[-1]])):
        out.add(before[-1])
    return out


def _up(block: Block | None) -> Iterator[Block]:
    while block is not None:
        yield block
        block = block.parent


def main_text(page: str) -> str:
    body = parse(page)
    parts = content(body)
    out: list[str] = []
    #: Blocks and texts still to read, the next one last, and whether they are content.
    todo: list[tuple[Block | str, bool]] = [(body, False)]
    while todo:
        item, whole = todo.pop()
        if isinstance(item, str):
            out.append(item if whole else "")
            continue
        inside = parts.get(id(item), ())
        if whole:
            out.append(" ")
            todo.append((" ", True))
        todo += [(x, whole or i in inside) for i, x in reversed(list(enumerate(item.items)))]
    return " ".join("".join(out).split())


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(p or "") for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of text).

    A null or empty page, and one of menus and the like alone, gives the text "" and 0.
    Broken markup is read as far as it goes, and however deep elements nest. A very
    long page is read whole, by itself. Of blocks with equal sums the outer, then the
    first counts. Repeated rows are extracted each on its own; extra columns are
    ignored; no rows in, no rows out.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")
