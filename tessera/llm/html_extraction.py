"""Main text of web pages by tree scoring.

The page is read into a light tree. A paragraph earns one point, one for each comma and up to
three for its length, discounted by the share of its text that is link text; its parent gets all of
that, the grandparent half, and further ancestors less and less. The best container wins, with
those siblings that score at least a fifth of it; inside an ``article`` or ``main`` it stands for the whole of
that element. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are cut out first, by element, role, or words of class and id. A first reading finds the elements with such
marks that are wrappers of the article instead (see ``_wrappers``); these stay, and marked elements inside them are cut.

Blocks come in page order, joined by one line feed; white space inside a block is one space;
character references are decoded. Cases: a null or empty page has an empty text; a page without
any paragraph points yields its article, main or body; markup that never closes is closed at the
end; elements deeper than `DEEPEST` are no elements of their own, as in browsers; after `BAD_QUOTES` tags whose quotes never close,
tags end at the first ``>``. So the time grows with the length of a page only. Equal pages give equal texts; pages
of any length are read whole; further columns are carried along, unless the new column has their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import map_arrow

#: Fixed values of HTML: elements without content, with raw content, and that break text into blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend summary".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body html main".split())

#: Elements, roles and words of class or id that mark what is not the article.
CUT_TAGS = frozenset("nav header footer aside form button select menu dialog head object audio video canvas map datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
NEVER_CUT = frozenset("html body article main".split())
#: Marked elements that can be a wrapper of the article; the other CUT_TAGS hold no text of an article.
SIDE_TAGS = frozenset("nav header footer aside form".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
STATES = frozenset("has no with without".split())
SOME, SIDE, COMMENTS, HIDDEN = 1, 2, 3, 4
DEEPEST = 512  # elements inside each other
REACH = 32  # ancestors that a paragraph gives points to
BAD_QUOTES = 64

_QUOTED = r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|(?P<open>\Z))"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|math|xmp)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|(?P<unended>\Z))"
    rf"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>{_QUOTED}|[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.I | re.S,
)
_SIMPLE = re.compile(_TOKEN.pattern.replace(_QUOTED + "|", ""), re.I | re.S)
_BALANCED = re.compile(_QUOTED)
_NO_TEXT = re.compile(r"<[!?/]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tokens(html: str) -> Iterator[tuple[int, int, re.Match[str] | None]]:
    """(start, end, match) of tags, comments and raw elements in page order. After the last ``>`` there is no tag; what never closes takes the rest."""
    pattern, at, last, bad = _TOKEN, 0, html.rfind(">") + 1, 0
    while m := pattern.search(html, at, last):
        at = m.end()
        if m["open"] is not None or m["unended"] is not None:
            yield m.start(), len(html), m
            return
        yield m.start(), at, m
        attrs = m["attrs"]
        if attrs and bad <= BAD_QUOTES and ('"' in attrs or "'" in attrs) and not _BALANCED.fullmatch(attrs):
            bad += 1
            pattern = _SIMPLE if bad > BAD_QUOTES else _TOKEN
    if m := _NO_TEXT.search(html, max(at, last)):
        yield m.start(), len(html), None


class _Node:
    __slots__ = ("tag", "parent", "cut", "score", "order", "mark", "block")

    def __init__(self, tag: str, parent: _Node | None, cut: bool, order: int, mark: int = 0) -> None:
        self.tag, self.parent, self.cut, self.order, self.mark, self.score = tag, parent, cut, order, mark, 0.0
        self.block: _Node = self if parent is None or tag in BLOCK else parent.block


def _mark(tag: str, attrs: str) -> int:
    """0, or how an element is marked as not the article: never shown, a side container by all words of a name, by some, or reader comments."""
    if tag in CUT_TAGS and tag not in SIDE_TAGS:
        return HIDDEN
    found = SOME if tag == "form" else SIDE if tag in SIDE_TAGS else 0
    if not attrs or tag in NEVER_CUT:
        return found
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name == "role" and value.lower() in CUT_ROLES:
            found = max(found, SOME if value.lower() == "form" else SIDE)
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HIDDEN
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                cut = [w for w in words if w in CUT_WORDS]
                if cut and words[0] not in STATES:  # has-sidebar, no-comments: says what the page has, not what the element is
                    found = max(found, COMMENTS if COMMENT_WORDS.intersection(cut) else SIDE if len(cut) == len(words) else SOME)
    return found


def _blocks(html: str, wrappers: frozenset[int] | None = frozenset()) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """(node, text, characters in links) of the blocks that are not cut out, and all nodes.

    wrappers: order of the marked nodes that stay; None keeps all that can be shown, for the first reading.
    """
    root = _Node("html", None, False, 0)
    nodes, stack, blocks = [root], [root], []
    pieces: list[str] = []
    linked, at = 0, 0
    opened: dict[str, int] = {}
    skipped: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text and not stack[-1].cut:
            blocks.append((stack[-1].block, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def leave(to: int) -> None:
        for n in stack[to:]:
            opened[n.tag] -= 1
        del stack[to:]

    def close(to: int) -> None:
        flush()
        leave(to)

    def up_to(tags: tuple[str, ...], stop: frozenset[str]) -> int:
        if not any(opened.get(t) for t in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stop:
                return 0
        return 0

    for start, end, m in _tokens(html):
        if start > at and not stack[-1].cut:
            piece = html[at:start]
            pieces.append(piece)
            if opened.get("a"):
                linked += len(piece.strip())
        at = end
        tag = (m["tag"] or "").lower() if m else ""
        if not tag:
            continue
        if m["end"] and skipped.get(tag):
            skipped[tag] -= 1
            if tag in BLOCK:
                flush()
            continue
        if m["end"]:
            if tag in BLOCK:
                if k := up_to((tag,), frozenset()):
                    close(k)
                else:
                    flush()
            elif k := up_to((tag,), BLOCK):
                if stack[k].cut:
                    pieces.clear()
                leave(k)
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in ("html", "body") and len(stack) == 1 or tag in VOID and tag != "hr":
            if tag != "body":
                continue
        if tag in CLOSES_P and (k := up_to(("p",), SCOPES)):
            close(k)
        if tag in SAME_LEVEL and (k := up_to(SAME_LEVEL[tag], SCOPES)):
            close(k)
        if tag in BLOCK:
            flush()
        if tag == "hr":
            continue
        mark = _mark(tag, m["attrs"] or "")
        cut = stack[-1].cut or mark == HIDDEN or mark > 0 and wrappers is not None and len(nodes) not in wrappers
        if cut and not stack[-1].cut:
            flush()
        if len(stack) > DEEPEST and (not cut or stack[-1].cut):
            skipped[tag] = skipped.get(tag, 0) + 1
            continue
        node = _Node(tag, stack[-1], cut, len(nodes), mark)
        nodes.append(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(html) and not stack[-1].cut:
        pieces.append(html[at:])
    flush()
    return blocks, nodes


def _points(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked / len(text))


def _wrappers(html: str) -> frozenset[int]:
    """Order of the marked nodes that hold the article, so that they must not be cut.

    These hold a main; or an article with more points than all that is not in marked nodes, if no article or main is out of them;
    or half of the page's points at least, and twice what is not in marked nodes (if all words of a name are marks, or
    for side elements: if nothing else has points). Reader comments are wrappers only for what they hold in a main.
    """
    blocks, nodes = _blocks(html, None)
    if not any(0 < n.mark < HIDDEN for n in nodes):
        return frozenset()
    held, marked = [0.0] * len(nodes), [False] * len(nodes)
    for n in nodes[1:]:
        marked[n.order] = n.mark > 0 or marked[n.parent.order]
    outside = 0.0
    for node, text, linked in blocks:
        points = _points(text, linked)
        outside += 0.0 if marked[node.order] else points
        held[node.order] += points
    for n in reversed(nodes[1:]):
        held[n.parent.order] += held[n.order]
    has_main, has_article = [False] * len(nodes), [0.0] * len(nodes)
    free = any(n.tag in ("article", "main") and not marked[n.order] for n in nodes)
    for n in reversed(nodes):
        has_main[n.order] |= n.tag == "main" and not n.cut and held[n.order] > 0
        if n.tag == "article" and not n.cut:
            has_article[n.order] = max(has_article[n.order], held[n.order])
        if n.parent is not None:
            has_main[n.parent.order] |= has_main[n.order]
            has_article[n.parent.order] = max(has_article[n.parent.order], has_article[n.order])
    most = [n.mark != COMMENTS and held[n.order] * 2 > held[0] and (outside == 0 or n.mark == SOME and outside * 2 <= held[n.order]) for n in nodes]
    return frozenset(n.order for n in nodes if 0 < n.mark < HIDDEN and (has_main[n.order] or n.mark != COMMENTS and not free and has_article[n.order] > outside or most[n.order] and not free))


def main_text(html: str | None) -> str:
    """The main text of one page."""
    blocks, nodes = _blocks(html or "", _wrappers(html or ""))
    if not blocks:
        return ""
    for node, text, linked in blocks:
        points = _points(text, linked)
        holder, share, depth = (node.parent if node.tag not in ("div", "section", "article", "main", "body", "html", "td") and node.parent else node), 1.0, 1
        while holder is not None and depth <= REACH:
            holder.score += points * share
            depth += 1
            share = 0.5 if depth == 2 else 1 / (3 * depth)
            holder = holder.parent
    best = max((n for n in nodes if not n.cut), key=lambda n: (n.score + 5 * (n.tag in ("article", "main")) * (n.score > 0), -n.order))
    for wanted in ("article", "main"):
        up = best
        while up is not None and up.tag != wanted:
            up = up.parent
        if up is not None:
            best = up
            break
    kept = [best]
    if best.parent is not None and best.score > 0:
        kept += [n for n in nodes if n.parent is best.parent and n is not best and not n.cut and n.tag != "a" and n.score >= max(best.score / 5, 2)]
    lists: dict[int, list[bool]] = {}
    for node, text, linked in blocks:
        if node.tag == "li" and node.parent is not None:
            lists.setdefault(node.parent.order, []).append(linked > 0.8 * len(text))
    menus = {k for k, linkish in lists.items() if len(linkish) >= 3 and all(linkish)}
    chosen, inside = {k.order for k in kept}, [False] * len(nodes)
    for n in nodes:
        inside[n.order] = n.order in chosen or n.parent is not None and inside[n.parent.order]
    out = [text for node, text, _ in blocks if inside[node.order] and not (node.tag == "li" and node.parent is not None and node.parent.order in menus)]
    return "\n".join(out)


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """`pages` without its html, with the main text of each page."""
    keep = [f for f in pages.schema.fields if f.name not in (html, into)]
    names = [f.name for f in keep]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x) for x in batch.column("__h").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{into}` string"])
    return map_arrow(pages.select(*names, F.col(html).alias("__h")), extract, schema)
