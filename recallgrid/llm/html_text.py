"""Main text of web pages by tree scoring.

Each block of text gives points, one for itself, one for each comma and up to three for its length, less
the share of its text that is links, to its parent, half of them to its grandparent and less further up.
The container with most points, raised to the article element around it, is kept with those siblings that
score well beside it or read like prose. What is never article text (menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, comments of readers) is left out by element, role and
class or id; but a form, or what only a class or id speaks against, is scored if it holds most of the prose.

Null and empty pages give an empty text. Truncated and malformed markup is read as far as it makes sense, elements
nested deeper than 512 as neighbours. Rows are independent: repeated rows give repeated results, and ids and addresses may
be null and of any type. Pages are read whole, in time that grows with their length. An empty table gives no rows;
other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from recallgrid.llm import common

#: A quote is one only after an equals sign; what it opens and nothing closes runs to the end, so a page is read in one pass.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("nav footer aside form button select option menu dialog svg math object canvas audio video head fieldset label datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img br".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of a class or id that speak against an element, if its other words only say where it stands or what holds it:
#: `page-header` and `ad-slot` do, `article-header`, `notice-period` and `has-sidebar` don't.
_UNLIKELY = re.compile(
    r"ads?|adv|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|sidebar|aside|nav|navbar|navigation|menu|breadcrumbs?|foot|footer|masthead|topbar|header|comments?|commentlist|disqus|respond|replies|reply|notices?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|recirc|widget|pager|pagination|toolbar|skip|alert|rss|shoutbox|agegate"
).fullmatch
_PLACES = frozenset("area bar block blocks bottom box button buttons col column container first global group holder icons inner inline item items last left link links list lower main module outer page pane panel posts primary region right row secondary section side site slot sticky sub tools top unit upper widgets wrap wrapper zone articles stories".split())
_READERS = frozenset("comment comments commentlist disqus respond replies reply".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements stand at most this deep, as in browsers; what would be deeper becomes a neighbour.
_DEEPEST = 512
_IN_HEAD = frozenset("head base basefont bgsound link meta".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_START = {"div": 5.0, "article": 25.0, "main": 15.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "body": 0.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0}


class _Node:
    __slots__ = ("blocks", "children", "doubt", "drop", "keep", "level", "links", "out", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: _Node | None, out: bool) -> None:
        self.tag, self.parent, self.out, self.doubt = tag, parent, out, 0
        self.level = parent.level + 1 if parent else 0
        self.children: list[_Node] = []
        self.blocks: list[int] = []
        self.points = self.size = self.links = 0.0
        self.keep = self.drop = False


def _against(value: str, inside_article: bool) -> set[str]:
    """The words of a class or id that speak against its element."""
    found: set[str] = set()
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        unlikely = {w for w in words if _UNLIKELY(w)}
        if unlikely and not (inside_article and unlikely == {"header"}) and all(w in unlikely or w in _PLACES for w in words):
            found |= unlikely
    return found


def _leaves_out(tag: str, attributes: str, inside_article: bool) -> int:
    """0: no; 1: yes; 2: by class, id or form alone, so not if it holds most of the prose; 3: likewise, as readers' comments."""
    if (tag in _LEFT_OUT and tag != "form") or (tag == "header" and not inside_article):
        return 1
    found = 2 if tag == "form" else 0
    if not attributes or tag in ("html", "body", "main"):
        return found
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            words = _against(value, inside_article) if tag not in _HEADINGS else set()
            if tag == "article":
                if words & _READERS:
                    return 1
            elif words:
                found = max(found, 3 if words & _READERS else 2)
        elif tag != "article" and (name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "role" and value.lower() in _ROLES)):
            return 1
    return found


class _Page:
    """The blocks of a page in order, and the tree of elements that they stand in."""

    def __init__(self, page: str) -> None:
        self.root = self.at = _Node("html", None, False)
        #: In the order in which they begin, so a node comes after its parent.
        self.nodes = [self.root]
        self.texts: list[str] = []
        self.owner: list[_Node] = []
        self.linked: list[int] = []
        self.parts: list[str] = []
        self.doubts: list[_Node] = []
        self.in_links = self.link_depth = self.articles = 0
        end, n = 0, len(page)
        while end < n:
            m = _TAG.search(page, end)
            start = m.start() if m else n
            if start > end:
                self.text(page[end:start])
            if not m:
                break
            end = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self.close(tag)
            else:
                if tag in _RAW:
                    stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, end)
                    end = stop.end() if stop else n
                    continue
                self.open(tag, m[3])
        self.flush()
        if self.doubts:
            self.settle()

    def add(self, tag: str, parent: _Node, out: bool) -> _Node:
        node = _Node(tag, parent if parent.level < _DEEPEST else parent.parent, out)
        self.nodes.append(node)
        return node

    def measure(self) -> None:
        """Sums the sizes of texts, and of links in them, from the leaves up."""
        for node in self.nodes:
            node.size = node.links = 0.0
        for text, node, linked in zip(self.texts, self.owner, self.linked, strict=True):
            node.size += len(text)
            node.links += linked
        for node in reversed(self.nodes):
            if node.parent:
                node.parent.size += node.size
                node.parent.links += node.links

    def settle(self) -> None:
        """Leaves out what was in doubt, unless it holds most of the prose (as readers' comments, nearly all of it)."""
        self.measure()
        total = self.root.size - self.root.links
        gone = [x for x in self.doubts if x.size - x.links <= total * (0.5 if x.doubt == 2 else 0.9)]
        for x in gone:
            x.drop = x.out = True
            x.parent.children = [c for c in x.parent.children if not c.drop]
        for node in self.nodes[1:]:
            node.drop |= node.parent.drop
        kept = [k for k, node in enumerate(self.owner) if not node.drop]
        again = {k: i for i, k in enumerate(kept)}
        for node in {id(x): x for x in self.owner}.values():
            node.blocks = [again[b] for b in node.blocks if b in again]
        self.texts, self.owner, self.linked = ([x[k] for k in kept] for x in (self.texts, self.owner, self.linked))

    def text(self, raw: str) -> None:
        if self.at.tag == "head" and raw.strip():
            self.at = self.at.parent
        if not self.at.out:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.link_depth:
                self.in_links += len(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                node = self.at
                node.blocks.append(len(self.texts))
                self.texts.append(text)
                self.owner.append(node)
                self.linked.append(min(self.in_links, len(text)))
            self.parts = []
        self.in_links = 0

    def open(self, tag: str, attributes: str) -> None:
        if self.at.tag == "head" and tag not in _IN_HEAD:
            self.at = self.at.parent
        if tag in _INLINE:
            if tag == "br":
                self.parts.append(" ") if not self.at.out else None
            elif tag == "a":
                self.link_depth += 1
            if tag not in ("br", "img", "wbr", "a") and attributes and not self.at.out and _leaves_out(tag, attributes, bool(self.articles)):
                self.at = self.add(tag, self.at, True)
            return
        self.flush()
        self.link_depth = 0
        if tag in ("html", "body") and self.at is self.root:
            return
        if tag in _VOID:
            return
        node = self.at
        if tag in _ENDS_P:
            up = node
            while up.parent and up.tag not in ("p", "td", "th", "li", "div", "article", "section", "body", "main"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        for same, stop in ((("li",), ("ul", "ol", "menu")), (("tr",), ("table", "tbody", "thead", "tfoot")), (("td", "th"), ("tr", "table")), (("dt", "dd"), ("dl",)), (("option",), ("select",))):
            if tag in same:
                up = node
                while up.parent and up.tag not in stop and up.tag not in same:
                    up = up.parent
                if up.tag in same:
                    node = up.parent
        why = 1 if node.out else _leaves_out(tag, attributes, bool(self.articles))
        out = why == 1
        node = node if node.level < _DEEPEST else node.parent
        self.at = self.add(tag, node, out)
        if why > 1:
            self.at.doubt = why
            self.doubts.append(self.at)
        if tag in ("article", "main"):
            self.articles += 1
        if not out:
            node.children.append(self.at)

    def close(self, tag: str) -> None:
        if tag in _INLINE and tag != self.at.tag:
            if tag == "a":
                self.link_depth = max(0, self.link_depth - 1)
            return
        node = self.at
        while node.parent and node.tag != tag:
            if node.tag in ("article", "main", "td", "table") and tag in ("p", "li", "div", "span") and node.tag != tag:
                return
            node = node.parent
        if not node.parent:
            return
        if tag not in _INLINE:
            self.flush()
            self.link_depth = 0
        up = self.at
        while up is not node:
            self.articles -= up.tag in ("article", "main")
            up = up.parent
        self.articles -= tag in ("article", "main")
        self.at = node.parent


def main_text(page: str) -> str:
    """The article of one page: its blocks in page order, one on each line."""
    tree = _Page(page)
    if not tree.texts:
        return ""
    tree.measure()
    for text, node, linked in zip(tree.texts, tree.owner, tree.linked, strict=True):
        if len(text) < 25 or node.tag in _HEADINGS or node.tag in ("th", "caption"):
            continue
        points = (1 + text.count(",") + text.count("،") + text.count("、") + text.count("，") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        up, far = (node.parent if node.tag in ("p", "pre", "td", "li", "blockquote", "dd", "figcaption") and node.parent else node), 0
        while up and far < 5:
            up.points += points / (1, 2, 6, 9, 12)[far]
            up, far = up.parent, far + 1
    met = [x for x in tree.nodes if x.size]
    worth = {id(x): (x.points + (_START.get(x.tag, 0.0) if x.points or x.tag in ("article", "main") else 0)) * (1 - x.links / max(1.0, x.size)) for x in met}
    top = max([x for x in met if x is not tree.root] or [tree.root], key=lambda x: (worth[id(x)], -x.level))
    if worth[id(top)] <= 0:
        top = tree.root
    up = top
    while up.parent:
        up = up.parent
        if up.tag == "article" and not up.out:
            top = up
    keep = [top]
    if top.parent and top.tag not in ("article", "main"):
        least = max(10.0, worth[id(top)] * 0.2)
        for x in top.parent.children:
            if x is top or id(x) not in worth:
                continue
            density = x.links / max(1.0, x.size)
            if worth[id(x)] >= least or (x.tag == "p" and ((x.size > 80 and density < 0.25) or (0 < x.size <= 80 and density == 0 and any(tree.texts[b].rstrip().endswith((".", "!", "?")) for b in x.blocks)))):
                keep.append(x)
    for x in keep:
        x.keep = True
    menus = top.tag not in ("article", "main")  # a list of links in an article is part of it
    for x in tree.nodes:
        x.drop = False
        if x.parent and x.parent.keep and not x.keep:
            x.keep = True
            x.drop = x.parent.drop or (menus and x.tag in ("ul", "ol") and x.size > 20 and x.links / x.size > 0.8)
    return "\n".join(text for text, node in zip(tree.texts, tree.owner, strict=True) if node.keep and not node.drop)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("html_text")
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
