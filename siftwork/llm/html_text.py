"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; inline elements count as tags of the block around them. What is boilerplate by its
element or by a word of its class, id or role goes first. For each node that is left,

    density = (characters / tags) * log_b((characters / link characters) * (tags / link tags)),
    b = ln(characters * link characters / other characters + body's link share * characters + e),

counts the characters a tag carries, less where they sit in links. The sum of a node's child densities is largest where
many dense blocks stand side by side: that subtree is the main text. The least density on the path from there up to the
body is the threshold: blocks beside the subtree that reach it and are as dense as its own blocks belong to it too.
Where the subtree lies in an article, else in a main element, that element's whole content is the text.

Pages are independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwork.llm.common import fresh, nullable, rows_by_bytes

# Elements by their role on a page.
ASIDE = frozenset("nav footer aside form menu dialog button select fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a start tag of these ends, up to the nearest of the containers.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tr td th", "tfoot": "tbody tr td th"}
CONTAINERS = frozenset("article body div html main section table ul ol dl select td th blockquote".split())
#: Words of a class, id or role that name boilerplate.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login paywall sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar "
    "topbar comment comments disqus respond replies reply related recommended recommendations trending share sharing social widget widgets search skip complementary contentinfo".split()
)
#: Names such as with-sidebar say what an element stands beside, not what it is.
BESIDE = frozenset("has with no without is".split())
#: Elements that are not dropped for their names; of articles only those that say what they are not.
KEPT = frozenset("html body main".split())
NO_ARTICLE = frozenset("comment comments reply replies related teaser promo ad advert advertisement sponsored widget".split())

#: Comments; elements whose content is no markup; tags; other declarations; half a tag at the end. Tags end at the next "<", so that
#: unfinished ones cost no second look at the text behind them.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|title|textarea|iframe|svg|math|object|canvas|audio|video)\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*\Z",
    re.I | re.S,
)
LABEL = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
HIDES = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Node:
    """A block element: its parts in page order (text or Node), its own characters and tags."""

    __slots__ = ("chars", "density", "link_chars", "link_tags", "name", "parts", "tags", "total", "up")

    def __init__(self, name: str, up: Node | None):
        self.name, self.up, self.parts = name, up, []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.density = self.total = 0.0


def _boilerplate(name: str, rest: str, node: Node, forms: bool) -> bool:
    if name in ASIDE:
        return forms or name not in ("form", "fieldset")
    if name == "header":  # of the page; an article's own header holds its title
        while node is not None and node.name not in ("article", "main"):
            node = node.up
        return node is None
    if name in KEPT or not rest:
        return False
    if HIDES.search(rest):
        return True
    for found in LABEL.findall(rest):
        for label in "".join(found).lower().split():
            words = WORD.findall(label)
            if name == "article":
                if words and words[0] in NO_ARTICLE:
                    return True
            elif not NAMES.isdisjoint(words) and words[0] not in BESIDE:
                return True
    return False


def _ended(node: Node, at: Node, open_: dict[str, int]) -> Node:
    """Closes blocks from node up to, but without, `at`."""
    while node is not at:
        open_[node.name] -= 1
        node = node.up
    return at


def tree(page: str, forms: bool = True) -> Node:
    """The page's blocks. Missing end tags are made up for; what is boilerplate by name is left out, forms only if so told."""
    root = node = Node("html", None)
    links = 0  # anchors that are open
    open_: dict[str, int] = {}  # blocks that are open, by name
    dropped: list[str] = []  # open elements from the outermost dropped one on
    begun = False  # whether an article or main element has been met
    at = 0

    def say(text: str) -> None:
        if text and not dropped:
            node.parts.append(html.unescape(text))
            n = len(text) - text.count(" ")
            node.chars += n
            if links:
                node.link_chars += n

    for token in TOKEN.finditer(page):
        say(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name, rest = name.lower(), token["rest"]
        if dropped:  # only the end of the dropped element matters
            if token["close"]:
                if name in dropped:
                    del dropped[len(dropped) - 1 - dropped[::-1].index(name) :]
                elif name in ("article", "main", "body", "html"):
                    dropped.clear()  # it was never closed
            elif name in ("article", "main") and not begun and dropped[0] not in ("aside", "nav", "menu", "dialog") and not _boilerplate(name, rest, node, forms):
                dropped.clear()  # the page's text stands in it, or it was never closed
            elif name not in VOID and not rest.endswith("/"):
                dropped.append(name)
            if dropped or token["close"] and name not in ("article", "main", "body", "html"):
                continue
        if name not in BLOCK:
            if not token["close"] and name not in VOID and _boilerplate(name, rest, node, forms):
                dropped.append(name)
                continue
            if not token["close"]:
                node.tags += 1
            if name == "a":
                links = 0 if token["close"] else 1
                node.link_tags += links
            continue
        if name in ("html", "body", "head"):
            links = 0
            if name == "body" and not token["close"]:
                root.name = "body"
            continue
        if name in VOID:
            node.parts.append(" \n ")
            node.tags += 1
            continue
        if token["close"]:
            if open_.get(name):  # else nothing ends, however deep the tree is
                while node.name != name:
                    open_[node.name] -= 1
                    node = node.up
                open_[name] -= 1
                node, links = node.up, 0
            continue
        above = node
        while above.up is not None and above.name != "p" and above.name not in CONTAINERS:
            above = above.up
        if above.name == "p":  # a block ends a paragraph
            node = _ended(node, above.up, open_)
        elif name in CLOSES:
            above = node
            while above.up is not None and above.name not in CLOSES[name].split() and above.name not in CONTAINERS - {"td", "th"}:
                above = above.up
            if above.name in CLOSES[name].split():
                above = above.up
                while above.up is not None and name in ("tr", "tbody", "tfoot") and above.name in CLOSES[name].split():
                    above = above.up
                node = _ended(node, above, open_)
        links = 0
        if _boilerplate(name, rest, node, forms):
            dropped.append(name)
            continue
        begun = begun or name in ("article", "main")
        inner = Node(name, node)
        node.parts.append(inner)
        open_[name] = open_.get(name, 0) + 1
        node = inner
    say(page[at:])
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, those above before those below."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Sets density and total (the sum of child densities) of every node; characters and tags become those of subtrees."""
    nodes = _nodes(root)
    for node in reversed(nodes):
        if node.up is not None:
            up = node.up
            up.chars, up.tags, up.link_chars, up.link_tags = up.chars + node.chars, up.tags + node.tags, up.link_chars + node.link_chars, up.link_tags + node.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        c, lc, lt = node.chars, node.link_chars, node.link_tags
        if c:
            base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
            ratio = (c / max(1, lc)) * (node.tags / max(1, lt))
            node.density = c / node.tags * math.log(max(1.0, ratio)) / math.log(base) if base > 1.0001 else c / node.tags * math.log(max(1.0, ratio)) * 10_000
    for node in nodes:
        # Text of its own, beside its child blocks, counts as one more child.
        below = sum(p.density for p in node.parts if isinstance(p, Node))
        own = sum(len(p) - p.count(" ") for p in node.parts if isinstance(p, str))
        node.total = below + (node.density * own / node.chars if node.chars else 0.0)
    return nodes


def _whole(node: Node, out: list[str]) -> None:
    """The texts of the blocks below, in page order; text between two blocks is a block."""
    stack: list = [node]
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    while stack:
        part = stack.pop()
        if isinstance(part, str):
            run.append(part)
        elif part is None:
            end()
        else:
            end()
            stack.append(None)
            stack += reversed(part.parts)
    end()


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by one space; empty for null and for pages without text."""
    if not page:
        return ""
    root = tree(page)
    nodes = measure(root)
    if not root.chars:  # a form may hold the whole page
        root = tree(page, forms=False)
        nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)  # the first in page order of equal ones
    threshold, node, home = best.density, best, None
    while node is not None:
        threshold = min(threshold, node.density)
        if node.name == "article" or node.name == "main" and home is None:
            home = node
        node = node.up
    out: list[str] = []
    if home is not None:
        _whole(home, out)
        return " ".join(out)
    # Beside the subtree: blocks over the threshold that are no worse than a block of the subtree itself.
    dense = [p.density for p in best.parts if isinstance(p, Node) and p.density > 0]
    least = max(threshold, min(dense, default=best.density))
    chosen, above = {id(best)}, best
    while above.up is not None:
        chosen.update(id(p) for p in above.up.parts if isinstance(p, Node) and p is not above and (p.density >= least or re.fullmatch("h[1-3]", p.name)))
        above = above.up
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            _whole(node, out)
        else:
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return " ".join(out)


def extract(pages: DataFrame, column: str = "html", batch_bytes: int = 4 << 20) -> DataFrame:
    """Adds text and n_chars (code points) to pages; existing columns of these names are replaced, others stay.

    A null or empty page has an empty text. Every row gives one row, repeated ones too. Half a tag at the end of a page is no
    text. White space, no-break spaces included, becomes one space. A task holds one batch of pages, of one page at least.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    page_ = fresh("__page", kept)
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias(page_))
    schema = StructType([*nullable(rows.select(*[F.col(f"`{c}`") for c in kept]).schema).fields]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, page_, batch_bytes):
            texts = [main_text(p) for p in batch.column(len(kept)).to_pylist()]
            columns = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
