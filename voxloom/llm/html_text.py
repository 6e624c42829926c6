"""Main text of web pages by composite text density.

For every node of a page's tree: its characters per tag, corrected by the share of linked characters and
tags. The density sum of a node is that of its children, and the node with the largest sum is the core of
the main text. The smallest density on its way up to the body is the threshold.

- The core grows to the outermost article (or main part) around it that is at least as dense as what is around
  that: an article of links and short lines doesn't take its place.
- From there it grows on to its parent while that has other children at least as dense as the threshold, or headings,
  and takes those and what lies between them.

Menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader comments are no
part of it. Tags and roles that say so are cut out of the tree beforehand. Names of classes count for containers only,
as whole names, and only where the density agrees: a container that has the core of the text stays, whatever its
name (of reader comments only if there is no other text).

Defined cases: null or empty html, and pages without text, give an empty text; unclosed, stray and unknown tags
are taken much as browsers take them; a null id stays null; repeated rows each give a row; an empty table
gives no rows; further columns are ignored; pages of any length are read whole, in time linear in it.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, id_type, slices

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_set = lambda names: frozenset(names.split())
# fixed values of HTML
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title noembed noframes xmp")
BLOCK = _set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul"
)
ENDS_P = BLOCK - _set("body html option td th tr tbody thead tfoot")
CLOSES = {"li": _set("li"), "dd": _set("dd dt"), "dt": _set("dd dt"), "option": _set("option"), "tr": _set("tr td th"), "td": _set("td th"), "th": _set("td th"), "tbody": _set("tbody thead tfoot tr td th"), "tfoot": _set("tbody thead tfoot tr td th")}
# what an end that is only implied doesn't reach beyond
P_SCOPE = _set("html body table td th button object")
TABLE_SCOPE = _set("html body table")
ITEM_SCOPE = _set("html body table ul ol dl article section main aside nav header footer select blockquote")
CLOSING = {
    t: [*([(_set("p"), P_SCOPE)] if t in ENDS_P else []), *([(CLOSES[t], ITEM_SCOPE if t in ("li", "dd", "dt", "option") else TABLE_SCOPE)] if t in CLOSES else [])]
    for t in ENDS_P | CLOSES.keys()
}
CUT_TAGS = _set("nav aside footer form script style noscript template iframe object svg math button select dialog menu head title textarea input canvas audio video")
CUT_ROLES = _set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form")
CONTAINERS = _set("div section ul ol dl table ins center details fieldset figure span")
COMMENTS = _set("comment comments disqus respond")
CUT_NAMES = COMMENTS | _set(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs consent cookie cookies footer masthead menu "
    "nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar widget"
)
# what a name may hold besides these
QUALIFIERS = _set("site page top bottom left right list box block area section wrapper wrap container inner slot unit post item bar links global primary secondary thread header")
HEADINGS = _set("h1 h2 h3 h4 h5 h6 hgroup")


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, named: str = ""):
        self.tag, self.parent, self.cut, self.named = tag, parent, cut, named
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _named(value: str) -> str:
    """Whether a class or id is the name of something that is no main text: ``comments``, ``other`` or nothing."""
    for name in value.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if all(x in CUT_NAMES or x in QUALIFIERS for x in parts) and not CUT_NAMES.isdisjoint(parts):
            return "other" if COMMENTS.isdisjoint(parts) else "comments"
    return ""


def _unwanted(tag: str, attributes: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element is cut out, and what its names call it."""
    if tag in CUT_TAGS or (tag == "header" and not inside_article):
        return True, ""
    named = ""
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id") and tag in CONTAINERS:
                named = named or _named(value)
            if name == "role" and value in CUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return True, named
    return False, named


def parse(html: str) -> Node:
    """The tree of a page: elements and texts. Where each tag is open is known, so nothing is searched for."""
    root = Node("html", None)
    stack = [root]
    open_: dict[str, list[int]] = {}
    limits: dict[frozenset, list[int]] = {scope: [0] for scope in (P_SCOPE, ITEM_SCOPE, TABLE_SCOPE, BLOCK)}
    position, n, body, broken = 0, len(html), False, False

    def enter(node: Node) -> None:
        open_.setdefault(node.tag, []).append(len(stack))
        for scope, depths in limits.items():
            if node.tag in scope:
                depths.append(len(stack))
        stack.append(node)

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            open_[tag].pop()
            for scope, depths in limits.items():
                if tag in scope:
                    depths.pop()

    while position < n:
        start = html.find("<", position)
        if start < 0:
            stack[-1].items.append(html[position:])
            break
        after = html[start + 1 : start + 2]
        if after in ("!", "?"):
            if start > position:
                stack[-1].items.append(html[position:start])
            end = html.find("-->", start + 4) + 2 if html.startswith("<!--", start) else html.find(">", start)
            position = end + 1 if end >= start else n
            continue
        m = None
        if after.isalpha() or after == "/":
            m = None if broken else _TAG.match(html, start)
            if m is None:
                m = _PLAIN_TAG.match(html, start)
                broken = broken or m is not None  # a quote that never ends: from here on quotes don't count
        if m is None:
            stack[-1].items.append(html[position : start + 1])
            position = start + 1
            if html.find(">", position) < 0:  # no tag can follow
                stack[-1].items.append(html[position:])
                break
            continue
        if start > position:
            stack[-1].items.append(html[position:start])
        position, tag = m.end(), m[1].lower()
        if after == "/":
            depths = open_.get(tag)
            inner = P_SCOPE if tag in BLOCK else BLOCK
            if depths and tag != "body" and (tag in inner or limits[inner][-1] < depths[-1]):
                close(depths[-1])
            continue
        if tag in ("html", "body"):
            if tag == "body" and not body:
                body = True
                close(1)
                node = Node("body", root)
                root.items.append(node)
                enter(node)
            continue
        for ends, scope in CLOSING.get(tag, ()):
            depths = [open_[t][-1] for t in ends if open_.get(t) and open_[t][-1] > limits[scope][-1]]
            if depths:
                close(min(depths))
        node = Node(tag, stack[-1], *_unwanted(tag, m[2], bool(open_.get("article") or open_.get("main"))))
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, position)
            stop = end.start() if end else n
            if not node.cut:
                node.items.append(html[position:stop])
            close_at = html.find(">", stop)
            position = close_at + 1 if end and close_at >= 0 else n
        elif tag not in VOID and not (m[2].endswith("/") and tag not in BLOCK):
            enter(node)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes that are not cut, parents before children."""
    out = [root]
    for node in out:
        node.items = [x for x in node.items if isinstance(x, str) or not x.cut]
        out += node.children()
    return out


def _measure(nodes: list[Node], body: Node) -> None:
    for node in reversed(nodes):
        children = node.children()
        node.chars = sum(len("".join(x.split())) for x in node.items if isinstance(x, str)) + sum(x.chars for x in children)
        node.tags = len(children) + sum(x.tags for x in children)
        linked = node.tag == "a"
        node.link_chars = node.chars if linked else sum(x.link_chars for x in children)
        node.link_tags = node.tags if linked else sum(x.link_tags + (x.tag == "a") for x in children)
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        node.density = 0.0
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-9) / math.log(max(base, 1.0) + 1.0)
        node.total = sum(x.density for x in node.children())


def _core(nodes: list[Node]) -> Node:
    """The node with the largest density sum, the outermost of equals; of pages without tags the body."""
    best = max(nodes, key=lambda x: x.total)
    return best if best.total > 0 else nodes[0]


def _path(node: Node, body: Node) -> list[Node]:
    out = [node]
    while out[-1] is not body:
        out.append(out[-1].parent)
    return out


def _outermost(nodes: list[Node], kind: str) -> tuple[list[Node], set[int]]:
    """The containers of a kind that lie in no other of it, and all nodes inside of these; parents come first in ``nodes``."""
    inside: set[int] = set()
    outer = []
    for x in nodes:
        if id(x.parent) in inside:
            inside.add(id(x))
        elif x.named == kind:
            inside.add(id(x))
            outer.append(x)
    return outer, inside


def _without_named(body: Node) -> list[Node]:
    """The nodes left without containers whose names and densities say that they are no main text; measured. Containers that hold
    all the text of a page are its main text, whatever they are called; so are those that hold all but a tenth of the text
    outside links, if they are as dense as the path to the core."""
    nodes = _walk(body)
    for kind in ("comments", "other"):
        named = [x for x in nodes if x.named == kind]
        if not named:
            continue
        _measure(nodes, body)
        outer, inside = _outermost(nodes, kind)
        if sum(x.chars for x in outer) >= body.chars:
            held = inside
        elif kind == "comments":
            held = set()
        else:
            path = _path(_core(nodes), body)
            held = set(map(id, path))
            plain = lambda x: x.chars - x.link_chars
            if 10 * (plain(body) - sum(map(plain, outer))) < plain(body):
                threshold = min(x.density for x in path)
                kept = [x for x in outer if x.density >= threshold > 0]
                held |= {id(x) for node in kept for x in _walk(node)}
        for x in named:
            x.cut = id(x) not in held
        nodes = _walk(body)
    _measure(nodes, body)
    return nodes


def _main(nodes: list[Node], body: Node) -> list[Node]:
    """The subtrees of the main text, in page order."""
    best = _core(nodes)
    path = _path(best, body)
    threshold = min(x.density for x in path)
    for k in range(len(path) - 1, -1, -1):  # the outermost first
        if path[k].tag in ("article", "main") and path[k].density >= min((x.density for x in path[k + 1 :]), default=0.0):
            best = path[k]
            break
    while best is not body and best.tag not in BLOCK:  # an inline element is part of its block
        best = best.parent
    chosen = [best]
    while best is not body:
        children = best.parent.children()
        of_text = [x is best or (x.chars > 2 * x.link_chars and (x.density >= threshold or x.tag in HEADINGS)) for x in children]
        if sum(of_text) > 1:
            first, last = of_text.index(True), len(of_text) - 1 - of_text[::-1].index(True)
            chosen = [y for x in children[first : last + 1] for y in (chosen if x is best else [x] if x.chars > 2 * x.link_chars or not x.chars else [])]
        best = best.parent
    return chosen


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below a node, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(entities.unescape(x))  # a reference doesn't go on in another text
        else:
            if x.tag == "br":
                held.append(" ")
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    body = next((x for x in root.items if isinstance(x, Node) and x.tag == "body"), root)
    nodes = _without_named(body)
    return "\n\n".join(text for node in _main(nodes, body) for text in blocks(node))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text, n_chars) for each page."""
    kinds = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"id {id_type(pages, id_col)}, {kinds}text string, n_chars bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(0), 4 << 20):
                part = batch.slice(i, j - i)
                texts = [main_text(h) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    rows = pages.select(F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.col(id_col).alias("id"), *keep)
    return rows.mapInArrow(run, schema)


def op10(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumnRenamed("id", "page_id")
